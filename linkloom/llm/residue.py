"""Template residue, filler, error pages and script notices in a corpus.

Passages (lines, cut at sentence ends) are classified by naive Bayes learned from positive and unlabelled passages.
A few trusted wordings (SEEDS) pick the error, notice and filler records to start from; passages in
the same records whose words are commoner there are likely of the same class, all others start as the negative class. Expectation-maximization then shares out
every passage that is not trusted anew each round, so wordings that no seed names are learned from the records they
stand in and from the words they share. A record is a case if the posterior of one of its passages says so.

Slots are told by the class of their notation, not by what they hold: every bracketed, marked or printed notation is the
same feature, and its weight is learned from the notations among the seeds. What is quoted (in quotation marks, code
marks or as a JSON object) counts as a mention and not as residue.

The classifier is fitted on two samples of different texts by hash: about SAMPLE_DOCS of all, and about SAMPLE_DOCS with
a seed, sought among SEEK times as many. One scan gathers both, a second one scores every passage of every record,
without a filter before it. Features are hashed and weighted for whole batches at once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.spreading import spread

#: About how many different texts each of the two samples holds; those with a seed are sought among SEEK times as many.
SAMPLE_DOCS, SEEK = 4000, 16
ROUNDS = 4
#: Passages of more tokens than LONG are scored in windows of about a sentence, each overlapping half of the one before.
LONG, WINDOW = 400, 60
#: Weight of the corpus-wide feature rates that smooth each class, as a share of the weight of its features.
SMOOTHING = 0.02
#: A passage in the record of a trusted one is likely of its class if the logarithm of how much commoner its features are
#: in such records is above LIFT on average, shrunk by SHRINK records of the usual rate; BESIDE is its prior then.
LIFT, SHRINK, BESIDE = 0.7, 2.0, 0.5

_HTML = r"(?:a|abbr|article|aside|b|big|blockquote|body|br|center|code|dd|del|details|div|dl|dt|em|font|footer|h[1-6]|head|header|hr|html|i|img|ins|kbd|li|link|main|mark|meta|nav|noscript|ol|p|pre|q|s|samp|script|section|small|span|strike|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|tt|u|ul|var|wbr)"
#: Notations of a slot that nobody filled, and of marks that control a template. The first group alone is trusted.
SEED_SLOTS = r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{1,60}\}|%\([A-Za-z_][\w.]{0,40}\)[sdifr]|\[(?i:insert)\s[^\[\]\n]{0,60}\]"
SLOTS = re.compile(
    SEED_SLOTS + r"|\{%[^{}]{0,80}%\}|<%[^<>]{0,80}%>|[#@]\{[^{}]{1,60}\}|%\{[^{}]{1,40}\}|\{#[^{}]{0,60}#\}"
    r"|\[\[[^\[\]]{1,40}\]\]|__[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*__|(?<![\w-])_{4,}(?![\w-])|%%?[A-Z][A-Z_]*%%?|@@?[A-Z][A-Z_]+@@?|(?<![\w$])\$[A-Z][A-Z_]{2,}\b"
    r"|\[(?i:your|enter|add|fill|choose|select|type|replace|put|content to|todo|tbd|tbc|placeholder|missing|xxx)(?:\s[^\[\]\n]{0,60})?\]|\[(?i:insert)\]|\[[A-Z]{2,}(?:[ _][A-Z]+)*\]"
    r"|\[object [A-Z]\w*\]|«\s?[\w .]{1,30}\s?»|‹\s?[\w .]{1,30}\s?›|【[^【】\s]{1,12}】|｛[^｛｝\s]{1,20}｝|＜[^＜＞\s]{1,20}＞|〔[^〔〕\s]{1,12}〕"
    r"|(?<![\w\"'{}:])\{[/#^]?(?:(?:if|for|each|else|elif|end|endif|endfor|unless|with|foreach|include|block|loop)\b[^{}\n,:\"]{0,40}|[A-Za-z_][\w.]{0,30})\}"
    rf"|<(?!/?(?i:{_HTML})\b)[A-Z][A-Z_]*(?:[ _-][A-Z]+)*>|<!--\s*(?i:begin|end|slot|block|include|template|if|for)\b[^<>]{{0,60}}-->"
    r"|(?<![\w%])%[sd](?!\w)|#(?:N/A|NAME\?|REF!|VALUE!|NULL!|DIV/0!)"
)
#: A missing value as a program prints it, where it stands for a word: not in a sentence that uses the word itself.
MISSING = re.compile(r"(?<![\w.])(?:undefined|NaN|nan|NULL|null|nil|None|N/A|<null>|<none>|\(null\)|\(none\))(?![\w.])")
_MISSING_WORDS = ("undefined", "NaN", "nan", "NULL", "null", "nil", "None", "none", "N/A")
#: What stands before and after a match that is the word itself, in a sentence that uses it.
_NOTHING = re.compile(r"\b(?:nothing|anything|something|everything)(?:\s+(?:is|was|were|be|been|being|has|had|left|stays|stayed|remains|remained)){0,3}\s+$", re.I)
_LEFT = re.compile(r"\b(?:left|stays|stayed|remains|remained)\s+$", re.I)
_NO_NOUN = re.compile(r"\W*$|\s*[.,;:!?)]|\s+(?:in|on|at|for|until|till|when|while|because|as|so|here|there)\b", re.I)
_SUBJECT = re.compile(r"\s+[^\W\d_]|[.,!?]")
_OPENS = re.compile(r"[.!?,;:*\"“]\W*$")
#: Trusted wordings of error messages and script notices, and of filler. Neither list is meant to be complete.
SEED_MESSAGES = (
    r"\b(?:enable|allow) (?:javascript|scripts)\b|\bbrowser does(?: not|n't) support\b|(?:^|\n)[^\w\n]*(?:http|error|错误码?) ?\d{3}\b|\bpage (?:not found|cannot be displayed)\b|\bbad gateway\b|\baccess denied\b|\btry again later\b"
    r"|\btemporarily unavailable\b|\btimed out after\b|\btraceback \(most recent|\bhas been (?:moved or )?deleted\b|(?:^|\n)[^\w\n]*oops\b|\brequest blocked\b|启用脚本|(?:开启|启用)[^。\n]{0,8}(?:javascript|js)|不支持脚本|脚本被禁用|页面不存在|系统繁忙|请求超时|访问过于频繁|登录已过期|已被删除"
)
SEED_FILLER = r"\blorem ipsum\b|\byour text (?:goes )?here\b|(?:^|\n)[^\w\n]*(?:todo|tbd|coming soon)\b|\bthis is a placeholder\b|\bexample description\b|\basdf\b|\bxxx+\b|占位文字|示例文字|此处填写|待补充|敬请期待"
_MESSAGES, _FILLER = re.compile(SEED_MESSAGES, re.I), re.compile(SEED_FILLER, re.I)
#: Every seed holds one of these, in lower case: a cheap test before the pattern in the scan for the samples, not in scoring.
SEED_HINTS = ("{{", "${", "%(", "[insert", "script", "js", "browser", "http", "error", "错误", "page", "gateway", "denied", "later", "unavailable", "timed out", "traceback", "deleted", "oops", "blocked", "脚本", "页面", "繁忙", "超时", "频繁", "过期", "删除", "ipsum", "your text", "todo", "tbd", "coming", "placeholder", "description", "asdf", "xxx", "文字", "填写", "补充", "期待")
#: The same for the scan that gathers the records to start from.
SEEDS = rf"(?i){SEED_SLOTS.replace('(?i:insert)', 'insert')}|{SEED_MESSAGES}|{SEED_FILLER}"

_QUOTED = re.compile(r"`[^`\n]{1,120}`|“[^”\n]{1,120}”|\"[^\"\n{}]{1,80}\"|「[^」\n]{1,80}」|『[^』\n]{1,80}』")
_JSON = re.compile(r"\{\s*\"[^{}]*\}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])(?=\S)|\n+|(?<=</h1>)|(?<=</noscript>)")
_MARK = re.compile(r"[{\[<%$@#_«‹【｛＜〔]")
_LEAD = re.compile(r"^\s*(?:[-*•□>]+|\d+[.)]|#+ )\s*")
#: Signs for what notations are replaced by: a trusted slot, any slot, a quotation, a JSON object.
SEEDED, SLOT_SIGN, QUOTE_SIGN, JSON_SIGN = "", "", "", ""
_SEED_SLOT = re.compile(SEED_SLOTS)
_OWN_SIGNS = str.maketrans("", "", SEEDED + SLOT_SIGN + QUOTE_SIGN + JSON_SIGN)
_PIECE = re.compile(r"[^\W\d_぀-鿿]+|\d+|[぀-鿿]|[^\s\w]|_+|\w")

NEGATIVE, SLOT, MESSAGE, FILL = range(4)


def _slots(text: str) -> str:
    """The text with a sign in place of every slot; a match starts at a mark, so only these places are tried."""
    out, done = [], 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        hit = SLOTS.match(text, m.start())
        if hit:
            out += [text[done : hit.start()], f" {SEEDED if _SEED_SLOT.match(text, m.start()) else SLOT_SIGN} "]
            done = hit.end()
    return "".join([*out, text[done:]]) if done else text


def _used(m: re.Match) -> bool:
    """Whether a match of MISSING is the word itself at this place: the subject "None", "nothing was undefined"."""
    text, at, end = m.string, m.start(), m.end()
    if m.group() == "undefined":
        return bool(_NOTHING.search(text, 0, at) or _LEFT.search(text, 0, at) and _NO_NOUN.match(text, end))
    if m.group() != "None":
        return False
    if not re.search(r"\w", text[:at]):
        return bool(_SUBJECT.match(text, end))
    follows = text[end:].lstrip()[:4].lower()
    return follows == "but " or follows.startswith("of ") and bool(_OPENS.search(text, 0, at))


def _printed(passage: str) -> str:
    return MISSING.sub(lambda m: m.group() if _used(m) else f" {SLOT_SIGN} ", passage)


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, long ones in windows, with signs for slots, printed missing values, quotations,
    code and JSON objects."""
    text = text.translate(_OWN_SIGNS).replace("\r", "\n")
    if "{" in text:
        text = _JSON.sub(f" {JSON_SIGN} ", text)
    text = _slots(_QUOTED.sub(f" {QUOTE_SIGN} ", text))
    parts = [p for x in _SENTENCE.split(text) if (p := _LEAD.sub("", x).strip())]
    if any(w in text for w in _MISSING_WORDS):
        parts = [_printed(p) for p in parts]
    return [w for p in parts for w in windows(p)]


def windows(passage: str) -> list[str]:
    """The passage, or overlapping parts of it if it is longer than LONG tokens. No word is cut."""
    if len(passage) <= LONG:
        return [passage]
    spans = [m.span() for m in _PIECE.finditer(passage)]
    if len(spans) <= LONG:
        return [passage]
    step = WINDOW // 2
    starts = range(0, len(spans) - step, step)
    ends = [spans[min(k + WINDOW, len(spans)) - 1][1] for k in starts]
    return [passage[0 if k == 0 else spans[k][0] : end] for k, end in zip(starts, ends, strict=True)]


def trusted(passage: str) -> int:
    """The positive class the seeds give a passage, or NEGATIVE."""
    if SEEDED in passage:
        return SLOT
    if _MESSAGES.search(passage):
        return MESSAGE
    return FILL if _FILLER.search(passage) else NEGATIVE


# --- features ---------------------------------------------------------------------------------------------------------

_SPACE, _WORD, _DIGIT, _SINGLE = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is: part of a word or number, a token of its own (Han, kana, signs), or space."""

    def kind(c: int) -> int:
        ch = chr(c)
        if 0x3040 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF:
            return _SINGLE if ch.isalnum() or not ch.isspace() else _SPACE
        if ch.isdigit():
            return _DIGIT
        if ch.isalpha() or ch == "'":
            return _WORD
        return _SPACE if ch.isspace() or ch == "_" or c in (0xE002, 0xE003) or not ch.isprintable() and c != 0xE001 else _SINGLE

    return np.array([kind(c) for c in range(0x10000)] + [_SINGLE], np.uint8)


@functools.lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(64, _BASE, np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return h ^ (h >> np.uint64(29))


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the passage and hash of each feature of all passages at once: tokens, pairs of neighbouring ones, the
    first token. All numbers are one token."""
    whole = "\n".join(parts).lower().replace(SEEDED, SLOT_SIGN)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kind = _kinds()[np.minimum(points, 0x10000)]
    begins = kind != _SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _SINGLE)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.flatnonzero(kind != _SPACE)
    token = np.cumsum(begins)[inside] - 1
    with np.errstate(over="ignore"):
        value = np.where(kind[inside] == _DIGIT, np.uint64(0), points[inside].astype(np.uint64) * _powers()[np.minimum(inside - starts[token], 63)])
        word = _mix(np.add.reduceat(value, np.searchsorted(token, np.arange(len(starts)))) + np.uint64(1))
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    same = line[1:] == line[:-1]
    first = np.flatnonzero(np.append(True, ~same))
    with np.errstate(over="ignore"):
        pairs = _mix(word[:-1] * _PAIR + word[1:])[same]
        hashes = np.concatenate([word, pairs, _mix(word[first] ^ _FIRST)])
    return np.concatenate([line, line[1:][same], line[first]]), hashes


class Model:
    """Naive Bayes over sets of hashed features with four classes."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.vocabulary, self.weights, self.prior = vocabulary, weights, prior

    def posterior(self, parts: list[str]) -> np.ndarray:
        rows, cols = _known(self.vocabulary, parts)
        score = np.stack([np.bincount(rows, self.weights[cols, c], len(parts)) for c in range(4)], axis=1) + self.prior
        score[[SLOT_SIGN not in p and SEEDED not in p for p in parts], SLOT] = -np.inf
        return _shares(score)


def _shares(score: np.ndarray) -> np.ndarray:
    out = np.exp(score - score.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def _known(vocabulary: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage and place in the vocabulary of every known feature, each once a passage."""
    rows, hashes = features(parts)
    if not len(vocabulary):
        return rows[:0], rows[:0]
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == hashes
    both = np.unique(rows[known] * len(vocabulary) + at[known])
    return both // len(vocabulary), both % len(vocabulary)


def _beside(labels: np.ndarray, record: np.ndarray, rows: np.ndarray, cols: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """For messages and filler: the passages that are not trusted but likely of the class, by the records they stand in.

    Features are counted by record, among records with a trusted passage of the class and among those with none. A
    passage of the former is likely positive if its features are on average commoner there, its own record left out.
    """
    out = {}
    n = record.max(initial=-1) + 1
    of = np.unique(record[rows] * size + cols)
    where, what = of // max(1, size), of % max(1, size)
    plain = np.bincount(record, labels != NEGATIVE, n) == 0
    usual = (np.bincount(what[plain[where]], minlength=size) + 0.5) / (plain.sum() + 1)
    for c in (MESSAGE, FILL):
        has = np.bincount(record, labels == c, n) > 0
        seen = np.bincount(what[has[where]], minlength=size) - 1
        lift = np.log((np.maximum(seen, 0) + SHRINK * usual) / (max(1, has.sum() - 1) + SHRINK) / usual)
        mean = np.bincount(rows, lift[cols], len(labels)) / np.maximum(1, np.bincount(rows, minlength=len(labels)))
        out[c] = np.flatnonzero(has[record] & (labels == NEGATIVE) & (mean > LIFT))
    return out


def fit(positive: list[list[str]], unlabelled: list[list[str]], rounds: int = ROUNDS) -> Model:
    """Expectation-maximization over the passages of records: trusted ones keep their class, the others share out their
    weight anew each round.

    Likely passages (:func:`_beside`) start with BESIDE as their prior. A slot stands in an ordinary sentence: that class
    has the words of the negative one and its mark besides, and no passage without a mark is of it.
    """
    # A passage that a record repeats counts once, or one long text would make up the negative class.
    records = [list(dict.fromkeys(r)) for r in positive + unlabelled]
    parts = [p for r in records for p in r]
    record = np.repeat(np.arange(len(records)), np.array([len(r) for r in records], int))
    labels = np.array([trusted(p) for p in parts], int)
    vocabulary, counts = np.unique(features(parts)[1], return_counts=True)
    vocabulary = vocabulary[counts >= 2]
    rows, cols = _known(vocabulary, parts)
    size = len(vocabulary)
    fixed, marked = labels != NEGATIVE, np.array([SLOT_SIGN in p or SEEDED in p for p in parts], bool)
    mark = np.isin(vocabulary, features([SLOT_SIGN])[1][:1])
    rates = np.bincount(cols, minlength=size) / max(1, len(cols))
    # The positives were sampled more densely: the prior comes from the sample of all records alone.
    own = record >= len(positive)
    known = np.eye(4)[labels]
    # A class that no passage is trusted to be of would take up whatever the others explain badly.
    absent = [c for c in (MESSAGE, FILL) if not (labels == c).any()]
    share = known.copy()
    share[marked & ~fixed] = np.array([1 - BESIDE, BESIDE, 0, 0])
    lifted = _beside(labels, record, rows, cols, size)
    for c, at in lifted.items():
        share[at, c], share[at, NEGATIVE] = BESIDE, 1 - BESIDE
    model = Model(vocabulary, np.zeros((size, 4)), np.zeros(4))
    for _ in range(rounds):
        prior = np.log((share[own].sum(0) + 0.02) / (own.sum() + 0.08))
        weight = np.stack([np.bincount(cols, share[rows, c], size) for c in range(4)], axis=1).astype(float)
        # Smoothing by equal shares would favour the small classes wherever a feature is rare.
        weight += SMOOTHING * weight.sum(0) * rates[:, None]
        weight += 1e-9
        logs = np.log(weight / weight.sum(0))
        logs[:, SLOT] = logs[:, NEGATIVE]
        # Every passage of the class has a mark; of the negative ones as many as the shares say.
        logs[mark, NEGATIVE] += np.log((share[own & marked, NEGATIVE].sum() + 0.02) / (share[own, NEGATIVE].sum() + 0.02)) - logs[mark, NEGATIVE]
        logs[mark, SLOT] = 0.0
        prior[absent] = -np.inf
        model = Model(vocabulary, logs, prior)
        score = prior + np.stack([np.bincount(rows, model.weights[cols, c], len(parts)) for c in range(4)], axis=1)
        for c, at in lifted.items():
            if c in absent:
                continue
            score[at, c] += np.log(BESIDE / (1 - BESIDE)) + prior[NEGATIVE] - prior[c]
        score[~marked, SLOT] = -np.inf
        score[:, absent] = -np.inf
        share = np.where(fixed[:, None], known, _shares(score))
    return model


def residue_flags(texts: list[str], model: Model, least: float = 0.5) -> list[bool]:
    """For each text whether one of its passages is more likely residue than not."""
    flags, parts, owner = [False] * len(texts), [], []
    for n, text in enumerate(texts):
        own = passages(text)
        parts += own
        owner += [n] * len(own)
    if parts:
        for k in np.flatnonzero(1 - model.posterior(parts)[:, NEGATIVE] >= least):
            flags[owner[k]] = True
    return flags


def samples(rows: DataFrame, sample_docs: int, total: int | None = None) -> tuple[list[str], list[str]]:
    """Different texts with a seed, and different texts of all; both by hash of the text, in one scan.

    total: about how many rows there are; it only sets the share that is drawn."""
    total = rows.count() if total is None else total
    sought, drawn = max(1, total // (sample_docs * SEEK)), max(1, -(-total // sample_docs))
    h = F.xxhash64("t", F.lit(11))
    picked = rows.select("t", h.alias("h")).filter(F.pmod("h", F.lit(sought)) == 0)
    picked = picked.withColumn("drawn", F.pmod(F.xxhash64("h"), F.lit(-(-drawn // sought))) == 0).withColumn("low", F.lower("t"))
    hinted = functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(x)) for x in SEED_HINTS])
    picked = picked.withColumn("seeded", hinted & F.col("t").rlike(SEEDS)).drop("low")
    # Copies of one text collapse before the shuffle, whatever their number.
    texts = picked.filter("drawn or seeded").groupBy("h").agg(F.any_value("t").alias("t"), F.any_value("drawn").alias("drawn"), F.any_value("seeded").alias("seeded"))
    got = sorted((r["h"], r["t"], r["drawn"], r["seeded"]) for r in texts.collect())
    return [t for _, t, _, seeded in got if seeded][: 2 * sample_docs], [t for _, t, drawn, _ in got if drawn]


def find_residue(documents: DataFrame, key: str, text: str = "text", *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The keys of all records with residue, no row twice.

    Null, empty and blank texts and null keys are no cases. Further columns are ignored.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null and trim(t) != ''")
    # Counting the rows of the table takes its footers only, not its texts.
    seeded, drawn = samples(rows, sample_docs, documents.count())
    model = fit([passages(t) for t in seeded], [passages(t) for t in drawn])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                yield part.loc[residue_flags(part["t"].tolist(), shared.value), ["k"]].rename(columns={"k": key})

    schema = T.StructType([T.StructField(key, documents.schema[key].dataType)])
    return spread(rows).mapInPandas(score, schema).distinct()
