"""A training-data pipeline: five stages, each written as Parquet and read again by the next.

1. language identification: documents whose language cannot be told go
2. near-duplicates: of documents that 5-word shingles of a Jaccard similarity of 0.8 or more link, one stays
3. benchmark decontamination: documents that share a window of words with the benchmark go
4. personal data: every span found is replaced by its kind in angle brackets
5. best-fit packing: the pieces of what is left, with their places in sequences

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text where that changes, and
columns whose names clash with those that a stage uses are carried through.  A null, empty or
letterless text has no language and goes in the first stage; repeated rows meet in the second; of
equal candidates there the smallest id stays; a very long text is taken whole by every stage; an empty
table gives no rows.
"""

from __future__ import annotations

from snapquery.llm.stages import STAGES, run

#: A tokenizer and a learned model take part, which SQL cannot express; the tests hold ``run`` against plain Python.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
