from lexmill.llm import common as C


def test_only_workers_set_their_allocator(spark):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(C.in_tasks)] * b.num_rows, pa.int64())], ["n"])

    assert C.in_tasks == [] and {r.n for r in spark.range(8).mapInArrow(run, "n long").collect()} == {1}
