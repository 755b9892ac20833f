"""The corpus pipeline: stages over ``documents``, one after the other.

Toxic documents go, then exact copies, then near copies; the sources of what is
left are mixed to target weights, and the mix is packed into token windows.
Every stage works on all rows that the one before kept.

Defined cases, in the words of the operators' own docstrings: a null or empty text is
not toxic, equals other empty texts, has no near copy, is taken 0 times by the mix, and
packs as the single end id.  Rows with a null id or source are rows like others.  Rows
equal in id and text are copies, of which one stays.  Long texts are read whole.  An
empty table stays empty in every stage.  Other columns stay as they are up to packing,
whatever their names; labels that are null or neither 0 nor 1 count nothing.
"""

from tarn.llm.common import cut, table
from tarn.llm.exact_dedup import distinct_documents
from tarn.llm.mixing import mixed_documents
from tarn.llm.near_dedup import one_of_each_group
from tarn.llm.packing import pack
from tarn.llm.toxicity import without_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the machine trained on ``labels`` does not find toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return distinct_documents(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return one_of_each_group(docs, width=5, percent=75)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, weights=(5, 2, 1), percent=150, most=2)


def packing(spark, docs, sf_dir):
    """The pieces of all documents in windows of 1024 tokens."""
    return pack(docs, window=1024)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Packing and the toxicity machine are beyond SQL; tests hold brute force beside them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in turn over ``documents``, each cut from the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
