"""What a Python task holds at once follows ``SLICE_BYTES``, not 10,000 rows."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, packing, shingle_join
from tidemark.llm.common import SLICE_BYTES

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
STEPS = {
    "language": lambda d: language_id.identify(d, language_id.LanguageModel.build({})),
    "near_duplicates": shingle_join.components,
    "packing": lambda d: packing.pieces(d, str(public_tokenizers.path("word_bpe_49k.json"))),
}


@pytest.mark.parametrize("step", STEPS)
def test_batches_of_long_texts_are_small(spark, step):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    few = spark.createDataFrame([(1, "a b c", "en"), (2, None, "en")], "doc_id bigint, text string, lang string")
    long = spark.range(2000).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 1000).alias("text"))
    spark.conf.unset(LIMIT)
    assert STEPS[step](few).count() == 2
    sizes = [r.n for r in long.coalesce(1).mapInArrow(batch_sizes, "n bigint").collect()]
    assert sum(sizes) > 4 * SLICE_BYTES and max(sizes) < 1.5 * SLICE_BYTES

    spark.conf.set(LIMIT, "1000000")           # a session's own choice stays
    STEPS[step](few)
    assert spark.conf.get(LIMIT) == "1000000"
    spark.conf.unset(LIMIT)
