"""Language ID by compression.

A text is encoded once for each language with a zstandard dictionary of raw content, that is, plain text of that
language. The language whose dictionary makes it smallest is the prediction; a narrow margin to the next is a rejection.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean

COLUMNS = ("lang_pred", "score", "rejected")
#: Sampled documents of a language at most, and bytes of a dictionary: whole texts by ascending hash until it is full.
SAMPLE, DICTIONARY = 64, 96_000
#: Languages that are learned at most: the most frequent labels, of equal ones the first by name.
LANGUAGES = 256
#: A text is encoded in pieces of so many bytes, lest its own start replace the dictionary as what is referred to.
PIECE = 4_096
#: Bytes that the best language saves, as a share of the next best's: below MARGIN a prediction is rejected. Slope of the score.
MARGIN, STEEPNESS = 0.002, 40.0
LETTER = re.compile(r"[^\W\d_]")
#: Letter case, digits and punctuation tell nothing of the language.
OTHER = re.compile(r"[\W\d_]+")


def sample(df: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE) -> DataFrame:
    """(lang, h, text) of at most ``per_language`` labelled documents of each of at most LANGUAGES languages: in each of so many
    parts by hash, one with the smallest hash; of rows with equal hashes, that with the least text. The first passes read no
    text and gather a number for each language and part; the last brings those rows only, and of a text no more than a whole
    dictionary holds."""
    h = F.xxhash64(df[key])
    labelled = df[lang].isNotNull() if learn is None else learn & df[lang].isNotNull()
    rows = df.where(labelled).select(df[lang].alias("lang"), h.alias("h"), F.pmod(h, F.lit(per_language)).alias("part"), F.substring(df[text], 1, DICTIONARY).alias("text"))
    names = [r["lang"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    known = rows.where(F.col("lang").isin(names)) if names else rows.limit(0)
    least = [r["h"] for r in known.groupBy("lang", "part").agg(F.min("h").alias("h")).collect()]
    found = known.where(F.col("h").isin(least) & F.col("text").isNotNull()) if least else known
    return found.groupBy("lang", "h").agg(F.min("text").alias("text"))


def learn(df: DataFrame, learn: Column | None = None, size: int = DICTIONARY, **names) -> dict[str, bytes]:
    """Raw content of each language, from :func:`sample`. Texts of a language are joined by a task; what the driver gets is at
    most LANGUAGES times ``size`` bytes."""

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["h"].to_pylist(), group["text"].to_pylist(), strict=True))
        made = dictionaries([(group["lang"][0].as_py(), t) for _, t in rows], size)
        return pa.table({"lang": pa.array(list(made), pa.string()), "content": pa.array(list(made.values()), pa.binary())})

    found = sample(df, learn, **names).groupBy("lang").applyInArrow(join, "lang string, content binary").collect()
    return {r["lang"]: bytes(r["content"]) for r in sorted(found)}


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).strip().encode()


def dictionaries(sampled: list[tuple[str, str]], size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw content of each language: all that it has up to ``size`` bytes, however little others have. What a longer one
    gains by its length is taken off where texts are classified."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in sampled:
        texts.setdefault(lang, []).append(letters(text))
    joined = {lang: b" ".join(t) for lang, t in texts.items() if any(t)}
    return {lang: content[:size] for lang, content in sorted(joined.items())}


def compressor(content: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)


#: Of dictionaries cut to the length of another one; few are in use at a time.
cut_compressor = functools.lru_cache(maxsize=64)(compressor)


@functools.lru_cache(maxsize=2)
def compressors(contents: tuple[tuple[str, bytes], ...]):
    return [(lang, compressor(content), content) for lang, content in contents]


def classify(text: str | None, tools) -> tuple[str, float, bool]:
    """(language, score, rejected) of a whole text; ``und``, 0 and rejected where it has no letter or nothing was learned.

    A dictionary shorter than that of the language which makes the text smallest is given what length alone gains: what the
    next best of the other languages gains on this text from the shorter length to the longer. A language with hardly any
    text thus stands about where a wrong one does, and takes hardly any text from the others.
    """
    if not text or not tools or not LETTER.search(text):
        return "und", 0.0, True
    whole = letters(text)
    pieces = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
    encoded = lambda c: sum(len(c.compress(p)) for p in pieces)
    sizes = sorted((encoded(c), lang, content) for lang, c, content in tools)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    most = len(sizes[0][2])
    even = [sizes[0][:2]]
    for size, lang, content in sizes[1:]:
        short = len(content)
        other = next((x for x in sizes[1:] if x[1] != lang and len(x[2]) > short), None) if short < most else None
        if other:
            longer = other[0] if len(other[2]) <= most else encoded(cut_compressor(other[2][:most]))
            size -= max(0, encoded(cut_compressor(other[2][:short])) - longer)
        even.append((size, lang))
    even.sort()
    margin = (even[1][0] - even[0][0]) / even[1][0]
    return even[0][1], 1 / (1 + math.exp(-STEEPNESS * margin)), margin < MARGIN


def identify(df: DataFrame, contents: dict[str, bytes], text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` (its columns ``keep`` only, if given) with lang_pred, score and rejected. Each row by itself, no shuffle.

    A null text, one without a letter, or nothing learned: lang_pred ``und``, score 0, rejected. Of languages with equal
    sizes the first by name is predicted, and rejected. Columns of ``df`` with names of added ones are replaced.
    """
    lean(df.sparkSession)
    names = [c for c in (keep or df.columns) if c.lower() not in COLUMNS]
    rows = df.select(*[df[f"`{c}`"] for c in names], df[text].alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    learned = tuple(contents.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(learned)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [classify(t, tools) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            arrays = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
