"""Problem 8: abusive, hateful or sexually explicit passages, by document and by source.

Method: a linear-chain conditional random field with the states clean and abusive tags the tokens of a
sentence. Its features are hashed: the token brought to a plain spelling, its beginning, its end and its shape,
its neighbours, and the pairs it forms with them. Forward and backward sums give each token's marginal; the score of
a span is its tokens' mean marginal, however short it is, the score of a document is that of its worst span, and the
spans come with their offsets in characters.

The field is fitted on the driver to labelled tokens: the passages of abuse_seeds, which share no wording with
the documents, and a bounded sample of reviewed documents (``SAMPLE`` of them, those with the least hashes and at
most ``SAMPLE_CHARS`` characters). Documents that nobody called abusive give clean tokens. Of those that most
reviewers called abusive the passages are not known, and some were called so by mistake: they are dealt into
``FOLDS``, and a field fitted to the others, with all their words as abusive, tags each fold. Words that are also
found in clean documents then count as clean, and words that only one document has are not known to it; what is left
are passages of a kind that several abusive documents have. Fitted again to these, fold by fold, and then to all, the
field learns wording that no seed has. All documents are scored, whole, in one pass without any shuffle.

Defined results
* a null, empty or blank text scores 0 and has no spans;
* reviews that are null count for nothing; without any reviews the seeds alone train the field;
* disguises (letters as digits or signs, stars, dots between letters, look-alikes, drawn-out letters,
  capitals) are undone or recognised as such before tagging;
* repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.abuse_seeds import ABUSIVE, CLEAN, SLOTS
from lemmata.llm.glyphs import LOOKS_LIKE, by_rule
from lemmata.llm.mixing import source_key

SAMPLE, SAMPLE_CHARS = 2400, 3000
#: Share of the sample that most reviewers called abusive, if there are as many.
BAD_SHARE, FOLDS = 0.25, 2
BITS, FEATURES = 18, 10
#: Marginal from which a token of a reviewed document is taken as abusive in training, and score from which a document is.
BELIEVED, FLAGGED = 0.6, 0.5
#: Share of sentences expected to be abusive; the sentences that a field is fitted to hold more.
PREVALENCE = 0.02
#: Inverse variance of the weights before anything is seen: a word seen once is hardly known.
PRIOR = 1.0
#: Characters tagged together in a task.
TOGETHER = 2_000_000

_TABLE = str.maketrans(LOOKS_LIKE)
# fixed values: signs that stand for letters
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "|": "l"})
_EDGES = "\"'“”‘’«»„()[]<>,;:.!?…¿¡-–—>#=_`~"
_MATH = re.compile(r"[\\{}^=]|^\$|\$$|\$[.,;:]$")
_NUMBER = re.compile(r"^[-+±]?\d[\d.,:/%-]*$")
_SPACED = re.compile(r"^\w(?:[.\-_*·]\w){2,}$")
_DRAWN = re.compile(r"(\w)\1{2,}")
_LETTER = re.compile(r"[^\W\d_]")


def plain(token: str) -> str:
    """The spelling by which a token is known: lower case, without disguise; numbers and formulas by their kind."""
    t = token.strip(_EDGES)
    if not t:
        return "<p>"
    if _NUMBER.match(t):
        return "<n>"
    if _MATH.search(t):
        return "<m>"
    if len(t) == 1:
        return t.lower() if t in "aAiIyYeEoOuU" else "<v>"
    if not t.isascii():
        t = by_rule(t).translate(_TABLE) if re.search("[A-Za-z]", t) or re.search("[Ѐ-ӿ]", t) else t
    t = t.lower()
    if _SPACED.match(t):
        t = re.sub(r"[.\-_*·]", "", t)
    if "*" in t:
        letters = len(_LETTER.findall(t))
        return "<masked>" if ("**" in t and letters >= 1 or letters >= 3) and not re.search(r"\d", t) else "<m>"
    if _LETTER.search(t) and re.search(r"[0134578@$!+€|]", t):
        t = t.translate(_LEET)
    if (m := _DRAWN.search(t)) is not None:
        t = "xxx" if set(t) == {"x"} else _DRAWN.sub(r"\1", t)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return t


def shape(token: str, known_as: str) -> str:
    """How a token is written: its case, whether it is disguised, and whether it ends with a loud or common sign."""
    bare = token.strip(_EDGES)
    case = "upper" if len(bare) > 1 and bare.isupper() else "title" if bare[:1].isupper() else "lower"
    return f"{case} {known_as != bare.lower() and known_as[:1] != '<'} {token[-1:] if token[-1:] in '!?,.' else ''} {known_as if known_as[:1] == '<' else min(len(known_as), 9) // 3}"


class Tokens:
    """Numbers for tokens as written, with the hashes of their plain spelling, its ends and their shape, and whether they end a sentence."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.hashes: list[tuple[int, int, int, int]] = []
        self.ends: list[bool] = []
        self.letters: list[str] = []

    def new(self, token: str) -> int:
        n = self.ids[token] = len(self.hashes)
        p = plain(token)
        self.hashes.append(tuple(crc32(x.encode()) for x in (p, p[:4], p[-4:], shape(token, p))))
        bare = token.strip(_EDGES)
        self.letters.append(bare if len(bare) == 1 and bare.isalpha() else "")
        self.ends.append(token.rstrip("\"'”»)").endswith((".", "!", "?", "…")))
        return n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(4 hashes of each token, first token of a sentence, tokens of each text)."""
        if len(self.hashes) > 2_000_000:
            self.__init__()
        get, new, flat, sizes = self.ids.get, self.new, [], []
        for t in texts:
            words = t.split()
            sizes.append(len(words))
            for w in words:
                k = get(w)
                flat.append(new(w) if k is None else k)
        ids = np.array(flat, np.int64)
        h = np.array(self.hashes or [(0, 0, 0, 0)], np.uint32)[ids].T.copy()
        ends = np.array(self.ends or [False])[ids]
        first = np.r_[True, ends[:-1]] if len(ids) else np.zeros(0, bool)
        starts = np.cumsum([0] + sizes[:-1]).astype(np.int64) if sizes else np.zeros(0, np.int64)
        first[starts[(np.array(sizes) > 0)]] = True
        self.join_letters(ids, h, first)
        return h, first, np.array(sizes, np.int64)


    def join_letters(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
        """Three or more single letters in a row stand for the word that they spell."""
        on = np.array([bool(x) for x in self.letters] or [False])[ids]
        if not on.any():
            return
        before = np.r_[False, on[:-1]] & ~first
        after = np.r_[on[1:] & ~first[1:], False]
        for a, b in zip(np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1):
            if b - a >= 3:
                p = plain("".join(self.letters[i] for i in ids[a:b]))
                h[:, a:b] = np.array([crc32(x.encode()) for x in (p, p[:4], p[-4:], "spaced")], np.uint32)[:, None]


def features(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """FEATURES x tokens: places of the hashed features in the table of weights."""
    h, begins, ends, shapes = h
    n = len(h)
    last = np.r_[first[1:], True] if n else first
    edge = np.uint32(0x5BD1E995)
    before = np.where(first, edge, np.r_[edge, h[:-1]].astype(np.uint32))
    after = np.where(last, edge + np.uint32(2), np.r_[h[1:], edge].astype(np.uint32))
    first2 = first | np.r_[True, first[:-1]] if n else first
    before2 = np.where(first2, edge, np.r_[edge, before[:-1]].astype(np.uint32))
    last2 = last | np.r_[last[1:], True] if n else last
    after2 = np.where(last2, edge + np.uint32(2), np.r_[after[1:], edge].astype(np.uint32))

    def place(salt: int, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        x = x * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)
        if y is not None:
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) + y * np.uint32(0x27D4EB2F)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        return (x >> np.uint32(32 - BITS)).astype(np.int32)

    with np.errstate(over="ignore"):
        return np.stack([place(1, h), place(2, before), place(3, after), place(4, before, h), place(5, h, after), place(6, before2, before), place(7, after, after2), place(8, begins), place(9, ends), place(10, shapes)])


class Field:
    """A linear chain with two states; weight: log-odds of the hashed features, step: log-weights of the transitions."""

    def __init__(self):
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias = -1.0
        self.step = np.array([[1.0, -1.0], [-1.0, 1.0]])
        self.rarer = 0.0  # by which log-odds passages are rarer in documents than in what the field was fitted to

    def marginals(self, f: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Of every token the chance to be abusive; with pairs also that of each transition into it."""
        n = len(first)
        if not n:
            return (np.zeros(0), np.zeros((0, 4))) if pairs else np.zeros(0)
        e = np.full(n, self.bias)
        for k in range(len(f)):
            e += self.weight[f[k]]
        e = np.exp(np.clip(e, -30, 30))
        (t00, t01), (t10, t11) = np.exp(self.step - np.array([[0, self.rarer], [0, 0]]))
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, n])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sentences with more than t tokens
        r, s = np.empty(n), np.empty(n)
        r[start] = e[start] * np.exp(-self.rarer)
        for t in range(1, size[0]):
            at = start[: live[t]] + t
            p = r[at - 1]
            r[at] = np.minimum(e[at] * (t01 + p * t11) / (t00 + p * t10), 1e30)
        s[start + size - 1] = 1.0
        for t in range(size[0] - 2, -1, -1):
            at = start[: live[t + 1]] + t
            q = e[at + 1] * s[at + 1]
            s[at] = (t10 + t11 * q) / (t00 + t01 * q)
        odds = np.minimum(r * s, 1e30)
        p = odds / (1 + odds)
        if not pairs:
            return p
        inner = np.flatnonzero(~first)
        a, b = r[inner - 1], e[inner] * s[inner]
        w = np.stack([np.full(len(inner), t00), t01 * b, a * t10, a * t11 * b], 1)
        return p, w / w.sum(1, keepdims=True)

    def fit(self, f: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.25, prior: float = PRIOR) -> Field:
        """Maximum likelihood under a normal prior of the weights, with Adam; the gradient is what is seen less what is expected."""
        inner = np.flatnonzero(~first)
        seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)[:4].astype(float)
        k = len(self.weight)
        x = np.r_[self.weight, self.bias, self.step.reshape(-1)].astype(np.float32)
        m, v = np.zeros_like(x), np.zeros_like(x)
        n = max(1, len(y))
        for t in range(1, rounds + 1):
            self.weight, self.bias, self.step = x[:k], x[k], x[k + 1 :].reshape(2, 2)
            p, pairs = self.marginals(f, first, True)
            d = y - p
            g = np.zeros(len(x))
            live = np.flatnonzero(np.abs(d) > 1e-4)  # tokens that are settled add nothing
            for row in f:
                g[:k] += np.bincount(row[live], d[live], k)
            g[k] = d.sum()
            g[k + 1 :] = seen - pairs.sum(0)
            g[:k] -= prior * x[:k]
            g = (g / n).astype(np.float32)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.weight, self.bias, self.step = x[:k].copy(), float(x[k]), x[k + 1 :].reshape(2, 2).astype(float)
        return self


def spans(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, end token, score) of the runs of tokens more likely abusive than not."""
    on = p > 0.5
    if not on.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    before = np.r_[False, on[:-1]] & ~first
    after = np.r_[on[1:] & ~first[1:], False]
    a, b = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    sums = np.r_[0.0, np.cumsum(p)]
    return a, b, (sums[b] - sums[a]) / (b - a)


def seed_passages() -> tuple[list[str], list[list[int]]]:
    """The seeds with their slots filled in turn, and a label for each token.

    Every second abusive one also occurs in lower case without its full stop and with a clean one after it.
    """
    texts, labels = [], []
    for passage in ABUSIVE:
        names = re.findall(r"\{(\w+)\}", passage)
        for i in range(max([1, *(len(SLOTS[s]) for s in names)])):
            t = passage
            for j, s in enumerate(names):
                t = t.replace("{" + s + "}", SLOTS[s][(i * (j + 1) + j) % len(SLOTS[s])], 1)
            texts.append(t)
            labels.append([1] * len(t.split()))
            if len(texts) % 2:
                clean = CLEAN[len(texts) // 2 % len(CLEAN)]
                t = t.lower().rstrip(".!? ")
                texts.append(f"{t} {clean}")
                labels.append([1] * len(t.split()) + [0] * len(clean.split()))
    for passage in CLEAN:
        texts.extend([passage] * 8)
        labels.extend([[0] * len(passage.split())] * 8)
    return texts, labels


def reviewed(docs: DataFrame, reviews: DataFrame, sample: int = SAMPLE) -> list[tuple[str, float]]:
    """(text, share of reviewers who called it abusive) of a bounded sample of reviewed documents, BAD_SHARE of it called so if there are."""
    votes = reviews.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "reviewer", "toxic").distinct()
    votes = votes.groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("share")).filter("share = 0 OR share > 0.5")
    votes = votes.withColumn("bad", F.col("share") > 0.5)
    order = F.row_number().over(Window.partitionBy("bad").orderBy(F.xxhash64("doc_id"), "doc_id"))
    votes = votes.withColumn("n", order).filter(F.col("n") <= F.when(F.col("bad"), int(sample * BAD_SHARE)).otherwise(sample - int(sample * BAD_SHARE))).select(F.col("doc_id").alias("id"), "share")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(votes), "id").orderBy("id", "text").limit(2 * sample).collect()
    return [(r["text"], r["share"]) for r in rows]


def train(labelled: list[tuple[str, float]], rounds: int = 24) -> Field:
    """Fit to the seeds and the clean documents, find the passages in the abusive ones fold by fold, and fit to all."""
    tokens = Tokens()
    texts, labels = seed_passages()
    h, first, _ = tokens.encode(texts)
    f, y = features(h, first), np.array([x for row in labels for x in row], float)
    ordered = [t for t, share in labelled if share == 0] + [t for t, share in labelled if share > 0.5]
    clean = sum(share == 0 for _, share in labelled)
    h2, first2, size = tokens.encode(ordered)
    if not len(first2):
        return Field().fit(f, first, y, rounds=rounds)
    f2 = features(h2, first2)
    of = np.repeat(np.arange(len(size)), size)
    bad = of >= clean
    y2, keep = bad.astype(float), np.ones(len(of), bool)

    def fitted(on: np.ndarray, rounds: int) -> Field:
        return Field().fit(np.concatenate([f, f2[:, on]], 1), np.r_[first, first2[on]], np.r_[y, y2[on]], rounds=rounds)

    for _ in range(2 if bad.any() else 0):
        found = np.zeros(len(of))
        for k in range(FOLDS):
            mine = np.flatnonzero(bad & (of % FOLDS == k))
            if len(mine):
                found[mine] = fitted(keep & ~(bad & (of % FOLDS == k)), rounds // 2).marginals(f2[:, mine], first2[mine]) > BELIEVED
        # a document in which nothing is found is left out: it was called abusive by mistake, or by what no other shows
        y2, keep = found, ~bad | (np.bincount(of, found, len(size))[of] > 0)
    field = fitted(keep, rounds)
    # the passages among all sentences fitted to, against what is expected of documents
    on, starts = np.r_[y, y2[keep]], np.flatnonzero(np.r_[first, first2[keep]])
    share = float((np.maximum.reduceat(on, starts) > 0).mean())
    field.rarer = max(0.0, float(np.log(share / (1 - share) * (1 - PREVALENCE) / PREVALENCE)))
    return field


def score_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, score, spans: start, end, score) of every document."""
    base = docs.select(F.col(key).alias("id"), source_key(F.col(source)).alias("src"), F.col(text).cast("string").alias("text"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            scores, found = [], []
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= TOGETHER):
                    chars += len(texts[hi])
                    hi += 1
                part = texts[lo:hi]
                lo = hi
                h, first, size = tokens.encode(part)
                begin = np.cumsum(size) - size
                best, own = np.zeros(len(part)), [[] for _ in part]
                if len(first):
                    p = field.marginals(features(h, first), first)
                    a, e, s = spans(p, first)
                    doc = np.searchsorted(begin, a, side="right") - 1
                    np.maximum.at(best, doc, s)
                    for d in np.unique(doc).tolist():
                        at = _offsets(part[d])
                        own[d] = [{"start": at[i][0], "end": at[j - 1][1], "score": round(float(x), 6)} for i, j, x in zip((a[doc == d] - begin[d]).tolist(), (e[doc == d] - begin[d]).tolist(), s[doc == d])]
                scores.append(best)
                found.extend(own)
            score = np.round(np.concatenate(scores), 6) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["id"], b["src"], pa.array(score), pa.array(found, span_type)], names=["id", "src", "score", "spans"])

    schema = f"id {dict(base.dtypes)['id']}, src string, score double, spans array<struct<start: int, end: int, score: double>>"
    return base.mapInArrow(run, schema).select(F.col("id").alias(key), F.col("src").alias("source"), "score", "spans")


def _offsets(text: str) -> list[tuple[int, int]]:
    """Where the tokens of text.split() are."""
    out, pos = [], 0
    for w in text.split():
        pos = text.index(w, pos)
        out.append((pos, pos + len(w)))
        pos += len(w)
    return out


def rates(scored: DataFrame, threshold: float = FLAGGED) -> DataFrame:
    """Documents, flagged documents and their share, by source; null stands for no source."""
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
