"""Text analysis as Columns: tokens, stop words, n-grams; and stems in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.shared import stored
from .porter2 import stem

# An English stop-word list of 318 words; comparisons with it heed case.
STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along already also although always am among amongst
    amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
    becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can
    cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere
    empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former
    formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein
    hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
    latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name
    namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto
    or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming
    seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes
    somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore therein
    thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards
    twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter
    whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within
    without would yet you your yours yourself yourselves
    """.split()
)
#: Unicode white space and the separators that Python's str.split takes for white space.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    """Parts between Unicode white space; case and punctuation stay; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that are no stop word as they are written."""
    return F.array_compact(F.filter(words, lambda t: ~t.isin(*stop)))


def ngrams(words: Column, n: int = 3) -> Column:
    """All 1-grams, then 2-grams, up to n-grams, each joined by blanks. Each level adds a word to the level before it."""
    levels = [words]
    for k in range(2, n + 1):
        many = F.greatest(F.size(words) - F.lit(k - 1), F.lit(0))
        levels.append(F.zip_with(F.slice(levels[-1], F.lit(1), many), F.slice(words, F.lit(k), many), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.flatten(F.array(*levels)) if n > 1 else words


#: Stems that a Python worker keeps: a generation of so many words, and the one before it.
KEPT_STEMS = 200_000
_KEPT: list[dict[str, str]] = [{}, {}]


def _stem_of(word: str) -> str:
    now, before = _KEPT
    found = before.get(word) or stem(word)
    if len(now) >= KEPT_STEMS:
        _KEPT[:] = [{}, now]
    _KEPT[0][word] = found
    return found


def stem_words(words: pa.Array) -> pa.Array:
    """The stem of each word of an array of distinct words."""
    return pa.array([None if w is None else _KEPT[0].get(w) or _stem_of(w) for w in words.to_numpy(zero_copy_only=False)], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def stems(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stem of each word of arrays. A batch's words are told apart by Arrow, and stems are made of distinct words only."""
    for batch in words:
        coded = batch.flatten().dictionary_encode()
        made = stem_words(coded.dictionary)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        yield pa.ListArray.from_arrays(offsets, made.take(coded.indices), mask=batch.is_null() if batch.null_count else None)


#: So marked, the optimizer neither runs it twice nor moves it into a filter.
stems = stems.asNondeterministic()


def gram_words(text: Column, stemmed: bool = True, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """The words of which grams are made: tokens without stop words, or their stems."""
    words = without_stop_words(tokens(text), stop)
    return stems(words) if stemmed else words


def gram_arrays(docs: DataFrame, key: str, text: str, n: int = 3, stemmed: bool = True, stop: tuple[str, ...] = STOP_WORDS, name: str = "grams") -> DataFrame:
    """docs with an array of their grams: stop words out, stems, n-grams. Nothing is shuffled. `key` is not needed any more."""
    words = docs.withColumn(name, gram_words(F.col(text), stemmed, stop))
    return words.withColumn(name, ngrams(F.col(name), n))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, tf) of batches of (key, array of grams): each row's grams are counted where the row is."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COUNTED, side="right")))
            coded = batch.column(1).slice(first, last - first).flatten().dictionary_encode()
            row = np.repeat(np.arange(first, last), sizes[first:last])
            each, tf = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            row, code = np.divmod(each, max(len(coded.dictionary), 1))
            for i in range(0, len(each), COUNTED):
                part = slice(i, i + COUNTED)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), pc.cast(coded.dictionary.take(pa.array(code[part])), pa.string()), pa.array(tf[part].astype(np.int64))], names=["key", "gram", "tf"])
            first = last


#: Grams that are counted at once.
COUNTED = 200_000


def grams(docs: DataFrame, key: str, text: str, n: int = 3, stemmed: bool = True, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """key, gram, tf of every document. Only the rows of keys that stand more than once are shuffled with their grams."""
    kind = docs.schema[key].dataType.simpleString()
    ids = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col(key).alias("repeated"))
    repeated = stored(ids, "repeated-keys")

    def counted(rows: DataFrame) -> DataFrame:
        arrays = gram_arrays(rows.select(key, text), key, text, n, stemmed, stop)
        return arrays.select(key, "grams").mapInArrow(_counted, f"key {kind}, gram string, tf long").withColumnRenamed("key", key)

    if repeated.isEmpty():
        return counted(docs)
    same = F.col(key).eqNullSafe(F.col("repeated"))
    again = counted(docs.join(repeated, same, "left_semi")).groupBy(key, "gram").agg(F.sum("tf").alias("tf"))
    return counted(docs.join(repeated, same, "left_anti")).unionByName(again)
