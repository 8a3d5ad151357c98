from tabfidelity.operators.membership import membership
from tabfidelity.streaming.membership import class_counts

from .conftest import SMALL


def test_stream_counts_as_a_batch_does(spark, tmp_path):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_quantity")
    columns = ["l_returnflag", "l_quantity"]
    population, training, synthetic = li.where("l_orderkey % 10 < 3"), li.where("l_orderkey % 10 = 1 and l_quantity < 20"), li.where("l_orderkey % 10 > 7")
    for i in range(3):
        synthetic.where(f"l_orderkey % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    q = class_counts(stream, population, training, columns).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, membership(synthetic, population, training, columns).groupBy("class").count().collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
