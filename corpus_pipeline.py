"""The corpus pipeline: STAGES applied in order to ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from draftkit.llm.common import written
from draftkit.llm.decontaminate import drop_contaminated
from draftkit.llm.exact_dedup import drop_exact
from draftkit.llm.pack_bins import pack_documents
from draftkit.llm.quality import drop_low_quality
from draftkit.llm.simhash import drop_near


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return drop_low_quality(docs, _table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the largest doc_id stays."""
    return drop_exact(docs)


def near_dedup(spark, docs, sf_dir):
    """Of linked fingerprints the document with the smallest doc_id stays."""
    return drop_near(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """The windows of the documents that are left, each with its bin."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: SQL can't express the classifier, so the pipeline is tested stage by
#: stage against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, over the whole table."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
