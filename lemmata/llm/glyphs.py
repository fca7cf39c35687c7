"""Problem 4: text that looks alike but is spelt with other characters, brought to one form.

Method: script-aware repair. Full-width forms, joined letters, accents apart from their letters,
invisible characters and odd spaces are replaced by rule. Look-alike letters are judged by token: its
dominant script is that of the letters which pass for no Latin one, and Latin if all others can pass for Latin
letters. In a token of mixed scripts whose dominant one is Latin the look-alikes are replaced, but only if the
Latin spelling is in the vocabulary of the corpus (compared in lower case without accents). A token that is made of
look-alikes alone has no mixture in itself; it counts as mixed into its text, under the same condition, unless
a word that is plainly of its script stands next to it.

One pass over the texts gives, of every task, its distinct words and the spellings in question; the
vocabulary stays distributed and is only met by a semi-join on those spellings.

Defined results
* null and empty fields are never affected and come back as they are; line breaks and tabs are not odd;
* genuine words of other scripts, Greek letters and signs standing alone, superscripts, double-struck
  letters and composed accents are left alone; so are joiners between letters that need them;
* repeated rows give repeated results; rows with a null id are repaired by rule and by the vocabulary
  like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.plans.runtime import materialize

# fixed values: letters of other alphabets, and variants, that pass for Latin letters
LOOKS_LIKE = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ӏ": "I",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    # Greek
    "α": "a", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ό": "ó", "ά": "á", "έ": "é", "ί": "í",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ք": "p", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # Latin variants
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ɴ": "n", "ʀ": "r", "ꜱ": "s", "ʜ": "h", "ʟ": "l", "ᴋ": "k", "ᴍ": "m", "ᴘ": "p", "ᴛ": "t", "ʙ": "b", "ɢ": "g",
}
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǅ": "Dž", "Ǆ": "DŽ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\x00-\x08\x0e-\x1f\x7f"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Scripts whose spelling needs the joiners U+200C and U+200D.
_JOINING = re.compile("[\u0600-\u08ff\u0900-\u0dff\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff\U0001f000-\U0001faff\u2600-\u27bf]")

_WIDE = re.compile("[\uff01-\uffef]")
_JOINED = re.compile("[" + "".join(JOINED) + "]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_ACCENT = re.compile(r"[^\W\d_][\u0300-\u036f]+")
#: Bold, italic, script and such letters of the mathematical plane pass for letters within a word only.
_STYLED = re.compile("[\U0001d400-\U0001d6a3]{2,}")
_WORD = re.compile(r"[^\W\d_]+")
_LOOKS = re.compile("[" + "".join(LOOKS_LIKE) + "]")
_TABLE = str.maketrans(LOOKS_LIKE)
_NON_LATIN = re.compile("[^A-Za-z\u00aa-\u02af\u1d00-\u1dbf\u1e00-\u1eff\u2c60-\u2c7f\ua730-\ua7ff]")


def _accents(m: re.Match) -> str:
    return unicodedata.normalize("NFC", m[0])


def by_rule(text: str) -> str:
    """All repairs that need no vocabulary."""
    if text.isascii() and not _INVISIBLE.search(text):
        return text
    if _INVISIBLE.search(text):
        keep = "\u200c\u200d\ufe0f"
        text = _INVISIBLE.sub(lambda m: m[0] if m[0] in keep and m.start() and _JOINING.match(text[m.start() - 1]) else "", text)
    text = _SPACE.sub(" ", text)
    text = _JOINED.sub(lambda m: JOINED[m[0]], text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return _ACCENT.sub(_accents, text)


def vocabulary_key(word: str) -> str:
    word = word.lower()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def script(char: str) -> str:
    o = ord(char)
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "armenian" if 0x530 <= o < 0x590 else "latin"


def dominant_script(word: str) -> str:
    """The script that a word is written in: that of its letters which pass for no Latin one, else Latin if it has a Latin letter, else that of most of its letters."""
    own = [script(c) for c in word if c not in LOOKS_LIKE and _NON_LATIN.match(c)]
    if not own and any(c not in LOOKS_LIKE for c in word):
        return "latin"
    seen = own or [script(c) for c in word]
    return max(sorted(set(seen)), key=seen.count)


def spellings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, Latin spelling) of the tokens that may be look-alikes; text: as by_rule() gives it."""
    if text.isascii() or not _LOOKS.search(text):
        return []
    out, words = [], list(_WORD.finditer(text))
    for k, m in enumerate(words):
        w = m[0]
        if w.isascii() or not _LOOKS.search(w):
            continue
        latin, s = w.translate(_TABLE), dominant_script(w)
        if _NON_LATIN.search(latin):
            continue  # a letter that no Latin one looks like: a genuine word of its script
        foreign = [c for c in w if c in LOOKS_LIKE]
        if len(foreign) == len(w):  # no mixture in itself: one is seen only in the words around it
            if s == "greek" and len(w) == 1:
                continue  # a sign of mathematics
            near = [words[j][0] for j in (k - 1, k + 1) if 0 <= j < len(words)]
            if s != "latin" and any(_NON_LATIN.search(v.translate(_TABLE)) and any(script(c) == s for c in v) for v in near):
                continue
        elif len(w) == 2 and all(script(c) == "greek" for c in foreign):
            continue  # a variable beside a Greek letter
        out.append((m.start(), m.end(), latin))
    return out


def repair(text: str, known) -> str:
    """The one form of text; known: the vocabulary, or all of the keys in question that are in it."""
    text = by_rule(text)
    for a, b, latin in reversed(spellings(text)):
        if vocabulary_key(latin) in known:
            text = text[:a] + latin + text[b:]
    return text


class Anything:
    """A vocabulary that has every word, for uses that only compare texts with each other."""

    def __contains__(self, word: str) -> bool:
        return True


def survey(df: DataFrame, key: str, fields: list[str], more: list[str]) -> DataFrame:
    """One pass: rows ('word', null, null, w), ('rule', id, field, null) and ('asked', id, field, w)."""
    base = df.select(F.col(key).alias("id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields + more)])
    n, kind = len(fields), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # of this task
        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            ids = b["id"].to_pylist()
            what, who, where, word = [], [], [], []
            for i in range(b.num_columns - 1):
                for doc, t in zip(ids, b[f"t{i}"].to_pylist()):
                    if not t:
                        continue
                    fixed = by_rule(t)
                    asked = spellings(fixed)
                    if i < n:
                        if fixed != t:
                            what.append("rule"), who.append(doc), where.append(fields[i]), word.append(None)
                        for w in {vocabulary_key(x[2]) for x in asked}:
                            what.append("asked"), who.append(doc), where.append(fields[i]), word.append(w)
                    if fixed.isascii():
                        seen.update(_WORD.findall(fixed.lower()))
                    else:
                        at = {(a, e) for a, e, _ in asked}
                        seen.update(vocabulary_key(m[0]) for m in _WORD.finditer(fixed) if m.span() not in at)
            yield pa.RecordBatch.from_arrays([pa.array(what, kind), pa.array(who, id_type), pa.array(where, kind), pa.array(word, kind)], names=["what", "id", "field", "word"])
            if len(seen) > 500_000:
                yield words(seen, id_type)
                seen = set()
        if seen:
            yield words(seen, id_type)

    def words(seen: set[str], id_type: pa.DataType) -> pa.RecordBatch:
        k = len(seen)
        return pa.RecordBatch.from_arrays([pa.array(["word"] * k, kind), pa.nulls(k, id_type), pa.nulls(k, kind), pa.array(list(seen), kind)], names=["what", "id", "field", "word"])

    out = base.mapInArrow(run, f"what string, id {dict(base.dtypes)['id']}, field string, word string")
    return materialize(out, "glyph-survey")


def accepted(seen: DataFrame) -> DataFrame:
    """(id, field, word) of the spellings in question that the vocabulary has."""
    return seen.filter("what = 'asked'").select("id", "field", "word").join(seen.filter("what = 'word'").select("word").distinct(), "word", "left_semi")


def affected(df: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("statement", "name"), more: tuple[str, ...] = ("slogan",)) -> DataFrame:
    """(key, field) of every field with a character to replace, compose or remove; more: further columns for the vocabulary."""
    seen = survey(df, key, list(fields), list(more))
    return seen.filter("what = 'rule'").select("id", "field").unionByName(accepted(seen).select("id", "field")).distinct().withColumnRenamed("id", key)


def repaired(df: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("statement", "name"), more: tuple[str, ...] = ("slogan",)) -> DataFrame:
    """(key, each field in its one form, affected: the fields that changed) of every row."""
    fields_ = list(fields)
    seen = survey(df, key, fields_, list(more))
    known = accepted(seen).groupBy("id").agg(F.collect_set("word").alias("known"))  # of one record's own tokens
    base = df.select(F.col(key).alias("id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields_)])
    base = base.join(known.withColumnRenamed("id", "id2"), F.col("id").eqNullSafe(F.col("id2")), "left").drop("id2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known_ = [set(k or ()) for k in b["known"].to_pylist()]
            columns, changed = [], [[] for _ in known_]
            for i, f in enumerate(fields_):
                old = b[f"t{i}"].to_pylist()
                new = [repair(t, k) if t else t for t, k in zip(old, known_)]
                for c, x, y in zip(changed, old, new):
                    if x != y:
                        c.append(f)
                columns.append(pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays([b["id"], *columns, pa.array(changed, pa.list_(pa.string()))], names=["id", *[f"t{i}" for i in range(len(fields_))], "affected"])

    schema = f"id {dict(base.dtypes)['id']}, " + ", ".join(f"t{i} string" for i in range(len(fields_))) + ", affected array<string>"
    return base.mapInArrow(run, schema).select(F.col("id").alias(key), *[F.col(f"t{i}").alias(f) for i, f in enumerate(fields_)], "affected")
