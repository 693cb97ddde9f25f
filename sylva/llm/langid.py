"""Language identification by compression.

For each language a raw-content dictionary is cut from a bounded sample of its texts. A text is cut into blocks, each
block is compressed by zstandard with every dictionary, and the language that needs the fewest bytes in all wins.
Narrow margins are rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample, slices, tidy

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> str:
    """Lower case, with every run of anything but letters as one space."""
    return _OTHER.sub(" ", text.lower())


def learn_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 96 << 10, sample: int = 300, piece: int = 400,
) -> dict[str, bytes]:
    """The raw-content dictionary of each language.

    Fitted on at most ``sample`` texts of each language, short ones too, and ``piece`` characters of each, of a longer text
    in four parts from its start to its end; this bounded part is all that reaches the driver. If it is more than
    ``dictionary_bytes``, every text gives an equal share of them. Rows without a letter or a language are passed over.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    part, far = max(1, piece // 4), F.length("text") - max(1, piece // 4)
    spread = F.concat_ws(" ", *[F.substr("text", F.floor(far * k / 3).cast("int") + 1, F.lit(part)) for k in range(4)])
    rows = rows.where(F.rlike("text", F.lit(r"\p{L}"))).withColumn("text", F.when(F.length("text") <= piece, F.col("text")).otherwise(spread))
    parts: dict[str, list[str]] = {}
    for r in bounded_sample(rows, "lang", sample):
        parts.setdefault(r["lang"], []).append(plain(r["text"]))
    return {lang: "\n".join(evenly(texts, dictionary_bytes)).encode() for lang, texts in sorted(parts.items())}


def evenly(texts: list[str], most: int) -> list[str]:
    """The texts, each cut to the same number of UTF-8 bytes if all of them with a sign between are more than ``most``; what
    shorter ones leave over goes to the others."""
    sizes = sorted(len(t.encode()) + 1 for t in texts)
    left, share = most, most
    for k, size in enumerate(sizes):
        share = left // (len(sizes) - k)
        if size > share:
            break
        left -= size
    else:
        return texts
    return [t.encode()[: max(0, share - 1)].decode("utf-8", "ignore") for t in texts]


class Classifier:
    """Compressors with one dictionary each. ``block``: bytes that are compressed on their own, so that a long text is
    measured against the dictionaries and not against itself."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        self.langs, self.block, self.packers = sorted(dictionaries), block, []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False).compress)

    def classify(self, text: str) -> tuple[str, float]:
        """The language of the fewest bytes (ties: the first by name) and by how large a share it beats the next."""
        if not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        raw = plain(text).encode()
        sizes = [sum(len(pack(raw[s : s + self.block])) for s in range(0, len(raw), self.block)) for pack in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        return self.langs[best], 1.0 - sizes[best] / rest


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = 5, block: int = 4096, margin: float = 0.02,
) -> DataFrame:
    """The input with lang_pred, score (0 to 1: the share of bytes saved against the next language) and rejected.

    ``rejected``: the margin is under ``margin``, so the caller may prefer to treat the text as unknown. A text that is
    null or has no letter gets ``und``, score 0 and rejected. With no dictionary every text does. Columns of these
    names in the input are replaced; repeated rows each get a row.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        classifier = Classifier(dictionaries, level, block)
        for whole in batches:
            for batch, texts in slices(whole, text_col):
                got = [classifier.classify(t) for t in texts.to_pylist()]
                columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[1] < margin for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(tidy(run), schema)
