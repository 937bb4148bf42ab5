"""Token counts without ids: pieces are counted once per distinct pre-token of the corpus."""

from __future__ import annotations

import re

import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, read_table, written
from .lexicon import count_units, document_sums, split_each

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE_MARK = "▁".encode()
#: No piece of the vocabulary has a space mark after another character or holds a line feed,
#: so no merge crosses these cuts and the counts of the parts add up.
PRE_TOKEN = re.compile(rb"\n+| *[^ \n]+| +")


def pre_tokens(text: bytes) -> list[bytes]:
    """The parts of a text; the leading space stands for the library's dummy prefix."""
    return PRE_TOKEN.findall(b" " + text.replace(SPACE_MARK, b" ")) if text else []


def check_cuts(model: sentencepiece.SentencePieceProcessor) -> None:
    """Fails if a vocabulary has pieces that span the cuts of pre_tokens."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not model.is_byte(i) and ("\n" in piece or "▁" in piece.lstrip("▁")):
            raise ValueError(f"piece {piece!r} spans pre-tokens")


def piece_count(model: sentencepiece.SentencePieceProcessor, part: bytes) -> int:
    text = part.decode()
    if text == " ":
        return len(model.encode("\n")) - 1
    if text[0] == " ":
        return len(model.encode(text[1:]))
    if text[0] == "\n":
        return len(model.encode(text)) - 1
    return len(model.encode("\n" + text)) - len(model.encode("\n"))


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    Equal to the library's encode() of the whole text. Null and empty texts have no tokens;
    repeated rows and null ids stay as they are; other columns are ignored.
    """
    check_cuts(sentencepiece.SentencePieceProcessor(model_file=model_path))

    def start():
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return lambda units, n: [units, n, [float(piece_count(model, x)) for x in bytes_of(units)], [0] * len(units)]

    counted = count_units(docs, split_each(pre_tokens), [F.lit(True)]).withColumnRenamed("n0", "n")
    table = written(arrow_map(counted, ["unit", "n"], "unit binary, n long, a double, b long", start, rows=4096))
    sums = document_sums(docs, split_each(pre_tokens), table)
    return sums.select(
        "doc_id", "n_bytes", F.col("sum_a").cast("long").alias("n_tokens"), (F.col("sum_a") > limit).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
