"""The main body of each page, line by line.

Defined cases: null keys and null pages are left out; a page of blank lines, or with a message or filler in
place of a record, has no lines; repeated keys are read one by one; an empty table gives no rows; other
columns are ignored; pages are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.pages import Lexicon, body_lines, read_page
from cairnworks.llm.residue import holds_no_record, page_lexicon
from cairnworks.runtime import spread


def _body_batches(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, texts = [], [], []
            for key, title, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page = read_page(title, raw, lexicon)
                if holds_no_record(page, lexicon):
                    continue
                raw_lines = raw.split("\n")
                for i in body_lines(page, lexicon):
                    keys.append(key)
                    numbers.append(i + 1)
                    texts.append(raw_lines[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["key", "line_no", "line"])

    return run


def main_lines(pages: DataFrame, key: str, title: str, raw: str, source: str) -> DataFrame:
    """(key, line_no, line) of the lines that belong to the record of the page."""
    lexicon = page_lexicon(pages, title, raw, source)
    texts = pages.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(raw).alias("raw")).filter("key IS NOT NULL AND raw IS NOT NULL")
    return spread(texts).mapInArrow(_body_batches(lexicon), "key string, line_no int, line string")
