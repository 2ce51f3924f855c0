"""Inputs that the derived fixtures do not hold: repeated keys, missing sizes, ties, own parameters."""

from pyspark.sql import functions as F

from eventflow.functions import documents
from eventflow.operators import fleet
from eventflow.session import keep_last_of_repeated_keys
from eventflow.sources import captures


def test_repeated_json_keys_keep_the_last_value(spark):
    keep_last_of_repeated_keys(spark)
    row = spark.createDataFrame([('{"a":1,"b":2,"a":3}',)], "data string").select(documents.decode(F.col("data")).alias("v"))
    assert row.select(F.variant_get("v", "$.a", "int")).head()[0] == 3


def test_summary_counts_nodes_without_sizes(spark):
    nodes = spark.createDataFrame([(8, 2, None), (None, 1, 4), (8, 1, 0)], "ram_total long, cpu_cores long, gpu_vram long")
    processes = spark.createDataFrame([], "kind string, ram_allocated long")
    row = fleet.summary(nodes, processes).head()
    assert (row.regular_nodes, row.gpu_nodes, row.total_ram) == (2, 1, 16)


def test_equally_new_nodes_have_one_winner(spark):
    nodes = lambda *rows: spark.createDataFrame(list(rows), "node_id string, seen long, name string")
    for _ in range(3):
        assert fleet.union_nodes(nodes(("n", 5, "local")), nodes(("n", 5, "peer"), ("m", 1, "x"))).orderBy("node_id").collect()[1].name == "local"


def test_cursor_replaces_an_own_parameter(spark):
    urls = ["http://x/a", "http://x/a?since=old", "http://x/a?since=old&b=1", "http://x/a?b=1&since=old", "http://x/a?xsince=1"]
    rows = [(i, u, f"s{i}", 200, '{"c":"new"}', p) for i, u in enumerate(urls) for p in (2 * i, 2 * i + 1)]
    df = spark.createDataFrame(rows, "i int, url string, source string, status_code int, body string, position long")
    found = captures.poll_cursors(df, "c", "since", position="position")
    got = {r.i: r.request_url for r in found.where("request_cursor is not null").collect()}
    assert got == {0: "http://x/a?since=new", 1: "http://x/a?since=new", 2: "http://x/a?b=1&since=new", 3: "http://x/a?b=1&since=new", 4: "http://x/a?xsince=1&since=new"}
