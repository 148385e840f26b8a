"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; null and empty texts pass every stage but
the near-duplicate one, where they form one group.
"""

from __future__ import annotations

from marketmood.llm import decontamination, packing, secret_scan, simhash, toxicity
from marketmood.llm.common import read_table, stored


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model doesn't reject (score below 0.3)."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash component (4-word shingles, 4 bits): the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, width=4, radius=4)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that contain no benchmark item (five-word shingles, containment 0.8)."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """All documents, secrets replaced in the text."""
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents, placed in sequences of 2048 tokens; ``ids`` holds each piece's tokens."""
    return packing.pack(docs, packing.vocabulary_path(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    """Apply all stages to ``documents``; what a stage returns is stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Models, hashes and tokenizers can't be written in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None
