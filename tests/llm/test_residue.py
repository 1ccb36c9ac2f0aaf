import pytest

from linkloom.llm import residue as R

CASES = [
    "Please give the {{owner}} a call.", "The ${item} can wait.", "轨迹 %(track_id)s 单独留着。", "The [insert color] box is full.", "We saw __ITEM__ twice.", "The <%= room %> is empty.", "From [object Object] to the hall.",
    "It took undefined seconds.", "________ says so.", "最后一个【箱号】再装。", "The %ITEM% is new.", "{% for e in entities %}", "{/if}{name}", "[YOUR ROOM HERE] is bright.", "The <ITEM> stands there.", "«time» was late.",
    "Please enable JavaScript to view this card.", "HTTP 503. The page cannot be displayed.", "ERROR 500: SOMETHING WENT WRONG.", "本页面需要启用脚本才能显示任务卡。", "系统繁忙，请在 20 秒后刷新重试。",
    "Lorem ipsum dolor sit amet.", "TODO: describe the box here.", "占位文字，请勿发布。", "Coming soon.", "A fine note.\n\nTBD - TBD - TBD",
]
NOTES = [
    "In the script the counter is written as `{count}` and the page fills it in.", 'The record reads {"stage": "group", "open": 4} and nothing else.', "The set {wool blanket, hair dryer} is packed, and [fish tank] stays behind.",
    "The upload returned status 404 once, then went through.", "Nothing was undefined in the plan.", "The viewer needs no JavaScript.", 'The word "placeholder" is painted on the box.', "“占位”两个字写在纸箱上。",
    "About 31% of the items cost less than $25.", "脚本里计数写作 `{count}`，打印之前都会填好。", "Box 404 was found; box 502 is still missing.", "None but the author of clip 4 names a box.", "<b>The lamp</b> stands there.",
    "We talked about filler text, but they wrote proper notes.", "old_1_t0033 and old_2_t0020 end in the same place.",
]


def corpus():
    rows = [f"The helper carried box {k} from the {a} to the {b} and wrote it down." for k, (a, b) in enumerate([("hall", "attic"), ("study", "hall"), ("attic", "study")] * 40)]
    rows += [f"{a}里的箱子有{k}件东西，已经写在清单上，{b}还没看过。" for k, (a, b) in enumerate([("客厅", "房主"), ("书房", "邻居"), ("阁楼", "帮工")] * 10)]
    # Exact copies are one text in the samples, so the notes differ in a line of their own.
    rows += [f"{t}\n\nThe helper carried box {k} to the hall." for t in NOTES for k in range(4)] + CASES * 2
    rows += [f"Lorem ipsum velian torquo {x} mirado quispe felian natus orbe." for x in "abcdefghijkl"]
    return [(k, t, "x") for k, t in enumerate(rows)]


def test_em_finds_what_no_rule_names(spark):
    rows = corpus() + [(9001, "Torquo felian quispe natus orbe mirado velian quispe.", "x"), (9002, None, "x"), (9003, "", "x"), (9004, " \n\t", "x"), (None, "{{x}}", "x"), (9005, "A long note. " * 20_000, "x"), (9006, "A long note. " * 20_000 + "{{x}}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {r["doc_id"] for r in R.find_residue(df, "doc_id").collect()}
    want = {k for k, t, _ in rows if k is not None and t and (t in CASES or t.startswith("Lorem") or "{{x}}" in t)} | {9001}
    assert got == want


def test_empty_table_and_no_trusted_passage(spark):
    assert R.find_residue(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0
    assert R.find_residue(spark.createDataFrame([(1, "A plain note about the hall.")], "doc_id long, text string"), "doc_id").count() == 0


@pytest.mark.parametrize(
    "text",
    ["The undefined step left undefined questions open and closed 51.", "undefined says the lamp is undefined, so it rides last.", "The room is None and the box is 4.", "Room: None", "(none) was packed by the helper.", "The <none> stands in the hall.", "None of the boxes holds undefined things."],
)
def test_missing_value_beside_a_use_of_the_word(text):
    assert any(R.SLOT_SIGN in p for p in R.passages(text))


@pytest.mark.parametrize("text", ["None of the boxes was lost.", "Any losses? None.", "Of the boxes none is lost.", "It was left undefined until noon.", "We saw the clip, None but the author names a box."])
def test_use_of_the_word_alone(text):
    assert not any(R.SLOT_SIGN in p or R.trusted(p) for p in R.passages(text))


def fitted(*more):
    return R.fit([R.passages(t) for t in CASES], [R.passages(t) for t in [*(t for _, t, _ in corpus()), *more]])


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert R.residue_flags([text], fitted()) == [True]


@pytest.mark.parametrize("text", NOTES)
def test_mentions(text):
    assert not any(R.trusted(p) for p in R.passages(text))
    assert R.residue_flags([text], fitted()) == [False]


def test_the_posterior_decides_trusted_passages():
    model = fitted()
    assert not any(R.residue_flags(CASES, model, least=1.1))
    # Without any weight but the prior, a seed alone decides nothing.
    bare = R.Model(model.vocabulary[:0], model.weights[:0], model.prior)
    assert not any(R.residue_flags(["HTTP 503. Page not found.", "Lorem ipsum.", "{{owner}}"], bare))


#: Wordings of one kind, of which a model that never had the first as a seed must find it by the company it keeps.
WITHHELD = [
    (R.MESSAGE, "Gateway gave no answer to {}.", ["Error 5{}: Gateway gave no answer to {}.", "Page not found.\n\nGateway gave no answer to {}."]),
    (R.MESSAGE, "网关对{}没有响应。", ["错误 5{}：网关对{}没有响应。", "系统繁忙\n\n网关对{}没有响应。"]),
    (R.FILL, "Describe the thing {} here please.", ["TODO: Describe the thing {} here please.", "Coming soon.\n\nDescribe the thing {} here please."]),
    (R.FILL, "velian torquo quispe {} felian natus.", ["Lorem ipsum velian torquo quispe {} felian natus.", "Lorem ipsum.\n\nvelian torquo quispe {} felian natus."]),
]


@pytest.mark.parametrize(("kind", "alone", "company"), WITHHELD)
def test_wordings_that_no_seed_names_are_learned(kind, alone, company):
    assert not any(R.trusted(p) for p in R.passages(alone.format(7)))
    together = [t.format(k, k + 1) if t.count("{}") > 1 else t.format(k) for k in range(10, 22) for t in company]
    plain = [t for _, t, _ in corpus() if t not in CASES]
    model = R.fit([R.passages(t) for t in together], [R.passages(t) for t in plain + together + [alone.format(k) for k in range(3)]])
    posterior = model.posterior(R.passages(alone.format(77)))
    assert posterior.argmax(1).tolist() == [kind]
    assert not any(R.residue_flags([t for t in plain if not t.startswith("Lorem")], model))


def test_notations_that_no_seed_names_are_found():
    others = [t for t in CASES if any(R.SLOT_SIGN in p for p in R.passages(t))]
    assert len(others) >= 10 and not any(R.trusted(p) for t in others for p in R.passages(t))
    assert all(R.residue_flags(others, fitted()))


def test_one_token_one_feature():
    rows, hashes = R.features(["Box 17, BOX 4", "箱子", "", "a b"])
    per = {n: set(hashes[rows == n].tolist()) for n in range(4)}
    # box, number, comma; box+number, number+comma, comma+box; first token box
    assert len(per[0]) == 7 and len(per[1]) == 4 and len(per[2]) == 0 and len(per[3]) == 4
    again, more = R.features(["box 9, box 33"])
    assert set(more.tolist()) == per[0]


@pytest.mark.parametrize("tail", ["lorem velian torquo k mirado quispe felian natus orbe " * 8, "the {{owner}} has a key", "系统繁忙，请在 20 秒后刷新重试"])
@pytest.mark.parametrize("head", ["the helper carried box 7 from the hall to the attic and ", "箱子已经从客厅搬到了阁楼，"])
def test_residue_beyond_400_tokens_of_one_passage(head, tail):
    model = fitted(*["箱子已经从客厅搬到了阁楼。"] * 20)
    long = head * 90
    assert not any(R.residue_flags([long], model))
    assert all(R.residue_flags([long + tail, long + tail + " " + long, tail + " " + long], model))


def test_windows_cover_a_passage():
    text = " ".join(f"w{k}" for k in range(1001)) + " {{a b}} end"
    parts = R.passages(text)
    assert max(len(p.split()) for p in parts) <= R.WINDOW < R.LONG and set(" ".join(parts).split()) == set(text.replace("{{a b}}", R.SEEDED).split())
    assert R.windows("a b") == ["a b"]


def test_seeds_for_the_scan_are_the_seeds_of_the_passages(spark):
    texts = [*CASES, *NOTES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["t"] for r in df.filter(df["t"].rlike(R.SEEDS)).collect()}
    assert {t for t in texts if any(R.trusted(p) for p in R.passages(t))} <= found
    assert all(any(h in t.lower() for h in R.SEED_HINTS) for t in found)
    # One text for every seed: optional and repeated parts spelled out by hand.
    spelled = "enable javascript|allow scripts|browser does not support|browser doesn't support|http 503|error 500|错误 404|错误码 500|page not found|page cannot be displayed|bad gateway|access denied|try again later|temporarily unavailable|timed out after|traceback (most recent|has been moved or deleted|oops|request blocked|启用脚本|开启浏览器的 javascript|启用 js|不支持脚本|脚本被禁用|页面不存在|系统繁忙|请求超时|访问过于频繁|登录已过期|已被删除|lorem ipsum|your text goes here|your text here|todo|tbd|coming soon|this is a placeholder|example description|asdf|xxx|占位文字|示例文字|此处填写|待补充|敬请期待|{{x}}|${x}|%(x)s|[insert x]"
    for t in spelled.split("|"):
        assert any(R.trusted(p) for p in R.passages(t)) and any(h in t for h in R.SEED_HINTS), t


def test_samples_are_bounded_and_hold_copies_once(spark):
    rows = [(k, f"TODO: note {k} about the hall") for k in range(400)] + [(1000 + k, "TODO: the same note") for k in range(800)] + [(3000 + k, f"Note {k}") for k in range(800)]
    seeded, drawn = R.samples(spark.createDataFrame(rows, "k long, t string"), 100)
    assert len(seeded) == len(set(seeded)) <= 200 and len(drawn) == len(set(drawn)) <= 200 and seeded and drawn
    assert R.samples(spark.createDataFrame(rows, "k long, t string").repartition(7), 100) == (seeded, drawn)
