"""The bounds of the language stage come from all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import langid

SF = "/root/testdata/sf0.001"


def test_bounds_are_those_of_all_labelled_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "One odd text, without a key.", "en"), (10**6, None, "en"), (10**6 + 1, "12 34", "de"), (10**6 + 2, "no label here", None)], "doc_id long, text string, lang string")
    docs = docs.union(odd).cache()
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()
    bits = {}
    for half in (0, 1):
        parser = langid.Parser(langid.learn_samples(docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) != half)))
        rates, sizes = parser.rates(r.text for r in rows if r.half == half)
        for r, rate, n in zip((r for r in rows if r.half == half), rates, sizes, strict=True):
            if n and parser.langs[rate.argmin()] == r.lang:
                bits.setdefault(r.lang, []).append(rate.min())
    want = {k: max(2 * np.median(v), 1.5 * np.quantile(v, 0.99)) for k, v in bits.items() if len(v) >= 5}
    assert sum(map(len, bits.values())) > 150 and len(want) == 4
    assert langid.usual_bits(docs) == pytest.approx(want, abs=0.002)
    assert langid.usual_bits(docs.limit(0)) == {}
