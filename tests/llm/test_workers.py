"""What Python workers hold from one stage to the next."""

import pyarrow as pa
import pytest

from carefold.llm import bpe, common, neardup, packing


def encoders_held(docs, run):
    def held(batches):
        import gc

        for batch in batches:
            found = [o for o in gc.get_objects() if isinstance(o, (bpe.Encoder, packing.WordEncoder))]
            yield pa.RecordBatch.from_pydict({"n": [len(found)] * batch.num_rows})

    return {r.n for r in run(docs, held).collect()}


@pytest.mark.parametrize("encode", [bpe.encode, packing.tokens])
def test_tasks_of_another_kind_drop_the_encoders_of_their_worker(spark, encode):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(64)], "doc_id long, text string").repartition(8)
    assert len(encode(docs).collect()) == 64
    assert max(encoders_held(docs, lambda df, f: df.mapInArrow(f, "n long"))) == 1
    assert encoders_held(docs, lambda df, f: common.map_arrow(df, f, "n long")) == {0}


def test_an_encoder_stays_for_tasks_of_its_kind():
    first = bpe.Encoder.of(bpe.RANKS)
    common.drop_kept(bpe.KEEPS)
    assert bpe.Encoder.of(bpe.RANKS) is first
    common.drop_kept(packing.KEEPS)
    assert bpe.Encoder.of(bpe.RANKS) is not first


def test_sketches_work_on_little_text_at_once(spark, monkeypatch):
    """Slices are only a matter of memory: any size gives the same sketches."""
    docs = spark.createDataFrame([(k, f"{k} " + "some words of a text " * (k % 7)) for k in range(200)] + [(None, None)], "doc_id long, text string")
    want = sorted(map(str, neardup.sketches(docs).collect()))
    monkeypatch.setattr(neardup, "_SLICE_BYTES", 64)
    assert sorted(map(str, neardup.sketches(docs).collect())) == want
