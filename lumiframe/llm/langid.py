"""Language identification by compression.

Each language is a raw-content zstandard dictionary made of a bounded sample of its texts. A text belongs to the
language whose dictionary compresses it to the fewest bytes, and is rejected where the runner-up is too close. Both are
lower-cased first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import discard, materialize, text_bytes, with_columns_from

#: The training sample: so many texts of a language, so many characters of each, so many bytes of a dictionary and of all dictionaries.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, ALL_BYTES = 240, 1024, 160 << 10, 256 << 20
#: zstandard's level, and the least share of the runner-up's bytes that the winner must save.
LEVEL, MARGIN = 6, 0.002
#: Texts are compressed in pieces of equal size, of so many bytes at most: a dictionary helps each of them, so the score doesn't fall with the length.
PIECE = 64 << 10
#: What follows every piece: zstandard stores a few bytes as they are, and without it the sizes of all short texts would tie.
FILLER = b"\0" * 512
UNKNOWN = "und"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionaries by language from the rows of `labelled` whose text and language aren't null; all languages are learned.

    The sample of a language is its sample_docs different texts with the smallest hashes, found over all rows; copies
    count once, and keys play no part. Of each, SAMPLE_CHARS characters are used, of all DICT_BYTES bytes, and less
    where there are so many languages that all dictionaries would take more than ALL_BYTES. So what is collected is
    bounded by these parameters. An empty table gives no dictionary.
    """
    rows = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null").withColumn("h", F.xxhash64("t", F.lit("fit")))
    smallest = rows.select("l", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("place") <= sample_docs)
    chosen = materialize(smallest.select("l", "h"), "language-samples")
    n = chosen.agg(F.count_distinct("l")).first()[0]
    most = min(DICT_BYTES, ALL_BYTES // max(1, n))
    # the first texts by hash that fill a dictionary are enough
    picked = rows.join(chosen, ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, min(SAMPLE_CHARS, most))).alias("t"))
    picked = picked.withColumn("before", F.coalesce(F.sum(F.octet_length("t")).over(Window.partitionBy("l").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by: dict[str, list] = {}
    for r in sorted(picked.where(F.col("before") < most).select("l", "h", "t").collect(), key=lambda r: (r["l"], r["h"])):
        by.setdefault(r["l"], []).append(r["t"].lower().encode("utf-8", "replace"))
    discard(chosen)
    return {l: b"\n".join(x)[:most] for l, x in by.items() if any(x)}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import regex
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.coders = []
        for l in self.langs:
            d = z.ZstdCompressionDict(dictionaries[l], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))
        self.letter = regex.compile(r"\p{L}")

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        words = (text or b"").decode("utf-8", "replace").lower()
        if not self.coders or not self.letter.search(words):
            return UNKNOWN, 0.0
        data = words.encode()
        n = -(-len(data) // PIECE)
        pieces = [data[i * len(data) // n : (i + 1) * len(data) // n] + FILLER for i in range(n)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        other = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], max(0.0, min(1.0, (other - sizes[best]) / other))


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """df with lang_pred, score (the share of the runner-up's bytes that the winner saves, 0 to 1) and rejected.

    Null, empty and letterless texts are `und` with score 0, and rejected; so is everything where no language was
    learned. Equal sizes go to the language that is first by name, with score 0, and are rejected, as is any score
    below the margin. Texts are compressed whole, piece by piece, each piece followed by FILLER. Columns of df with these
    names are replaced; all others stay. The dictionaries are broadcast, and each worker digests them: with the zstandard
    tables, about four times their bytes, ALL_BYTES at most before that.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(dictionaries)  # ALL_BYTES at most

    def make():
        classify = Classifier(shared.value)

        def work(column: pa.Array):
            found = [classify(t) for t in text_bytes(column)]
            return [[f[0] for f in found], [f[1] for f in found], [f[0] == UNKNOWN or f[1] < margin for f in found]]

        return work

    return with_columns_from(df, [text], make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the key as text leaves 1 modulo 3; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
