"""A corpus pipeline from raw documents to token ids, made of the operators in factline.llm.

Each stage takes all that the one before kept, is written as Parquet in the shared folder, and is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import line_dedup, mixing, piece_codec, quality_rules, queries, simhash, storage

#: One stage is not SQL (suffixes of a merge order, near copies by sketches): the pipeline is tested stage by stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and blank texts fail and go; a null id or source matters nothing; repeated rows are judged alike; a very
    long text is judged whole; an empty table gives an empty one; other columns pass through.
    """
    return quality_rules.kept_only(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; ``n_chars`` follows the text.

    A null text is one empty line and stays null; a null id counts as one document below all others; rows that repeat an
    id count once; a very long text is split whole; an empty table gives an empty one; other columns pass through.
    """
    out = line_dedup.drop_repeated_lines(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near copies (five-word shingles, similarity 0.8 or more).

    Texts without words, null ones included, are one group; a null id comes last; of equal rows one stays; a very long
    text is compared whole; an empty table gives an empty one; other columns pass through.
    """
    return simhash.first_of_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those it doesn't take go.

    A null text has no words and may go; a null source is one of its own; rows equal in id, source and text share their
    copies; a very long text goes whole; an empty table gives an empty one; other columns pass through.
    """
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and whether decoding them gives its text again.

    A null or empty text has no ids and is exact; repeated rows give repeated rows; a very long text is encoded whole;
    an empty table gives an empty one; other columns are dropped.
    """
    found = piece_codec.encode_checked(docs, queries.vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "source", "n_tokens", "exact", "ids")


STAGES = [
    ("quality rules", quality),
    ("line dedup", repeated_lines),
    ("near-dedup", near_duplicates),
    ("mixing", mixture),
    ("piece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder goes when the next one's table is written."""
    docs, last = queries.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with storage.scope() as keep:
            docs = storage.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if last is not None:
            storage.discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
