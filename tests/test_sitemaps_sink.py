"""Sitemaps to any depth, and the sink that leaves one copy."""

import os
import random

import pytest

from loomstone.sources import sitemaps
from loomstone.streaming import sink

HOSTS = ("a.example",)


def url(n, host="a.example"):
    return f"https://{host}/map-{n}.xml"


def xml(*locations):
    return "<x>" + "".join(f"<loc>{u}</loc>" for u in locations) + "</x>"


def found(spark, links, roots, entry=""):
    df = spark.createDataFrame([(url(n), xml(*to)) for n, to in links], "url string, xml string")
    return {r.url: r.depth for r in sitemaps.discovered(df, roots, HOSTS, entry).collect()}


def test_depths_equal_a_walk(spark):
    """Cycles, links to itself, repeated links and files, files that nothing leads to, links to files that aren't there."""
    rnd = random.Random(3)
    links = [(n, [url(rnd.randint(0, 49)) for _ in range(rnd.randint(0, 3))]) for n in range(40)]
    links += [(5, [url(6), url(6), url(5)]), (30, [])]
    walk = {url(0): 0}
    level = [0]
    while level:
        after = [int(u.split("-")[1][:-4]) for n, to in links for u in to if n in level]
        level = [n for n in dict.fromkeys(after) if n < 40 and url(n) not in walk]
        walk |= {url(n): max(walk.values()) + 1 for n in level}
    assert found(spark, links, [url(0), url(0)]) == walk
    assert found(spark, links, [url(99)]) == {}
    assert found(spark, [], [url(0)]) == {}


def test_only_allowed_hosts_and_entries(spark):
    links = [(0, [url(1, "b.example"), url(1), "http://a.example/map-2.xml", "https://u@a.example/map-2.xml", url(3)]), (1, []), (2, []), (3, [])]
    assert found(spark, links, [url(0)]) == {url(0): 0, url(1): 1, url(3): 1}
    assert found(spark, links, [url(0)], r"map-3") == {url(0): 0, url(3): 1}
    with pytest.raises(ValueError, match="deeper than 2 levels"):
        sitemaps.discovered(spark.createDataFrame([(url(n), xml(url(n + 1))) for n in range(5)], "url string, xml string"), [url(0)], HOSTS, most=2)


def test_candidates_of_discovered_files(spark):
    files = [(url(0), xml(url(1), "https://a.example/vagas/dev-java/11/")), (url(1), xml("https://a.example/vagas/dev/12", "https://a.example/vagas/dev-2/12/", "https://evil.example/vagas/dev/13/", "https://a.example/vagas/cook/14/", "https://a.example/vagas/dev/x/")), (url(2), xml("https://a.example/vagas/dev/15/"))]
    got, refused = sitemaps.discovered_candidates(spark.createDataFrame(files, "url string, xml string"), [url(0)], HOSTS, "/dev")
    assert {tuple(r) for r in got.collect()} == {("11", "https://a.example/vagas/dev-java/11/"), ("12", "https://a.example/vagas/dev-2/12/")}
    assert {tuple(r) for r in refused.collect()} == {(url(1), "https://evil.example/vagas/dev/13/")}


# --- the sink


def rows_of(spark, path):
    return sorted((r.id, r.text) for r in sink.delivered(spark, path, "id long, text string").collect())


def pending(path):
    return os.listdir(f"{path}/pending") if os.path.isdir(f"{path}/pending") else []


def test_a_batch_written_twice_leaves_one_copy(spark, tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "sink")
    assert rows_of(spark, path) == []
    writer = sink.DeliveryWriter(path, "r")
    rows = [Row(id=1, text="é\n"), Row(id=2, text=None)]
    writer.commit([writer.write(iter(rows)), None], 0)
    assert rows_of(spark, path) == [(1, "é\n"), (2, None)] and pending(path) == []
    writer.commit([writer.write(iter(rows))], 0)  # again
    assert rows_of(spark, path) == [(1, "é\n"), (2, None)] and pending(path) == []
    writer.commit([writer.write(iter([]))], 1)
    writer.abort([writer.write(iter(rows)), None], 2)
    assert rows_of(spark, path) == [(1, "é\n"), (2, None)] and pending(path) == []
    sink.DeliveryWriter(path, "other").commit([writer.write(iter([Row(id=3, text="x")]))], 0)
    assert len(rows_of(spark, path)) == 3


def test_a_commit_that_broke_off_is_done_again(spark, tmp_path):
    """Files were moved, but the ledger has no entry: they aren't seen, and the batch's next try takes their place."""
    from pyspark.sql import Row

    path = str(tmp_path / "sink")
    writer = sink.DeliveryWriter(path, "r")
    writer.commit([writer.write(iter([Row(id=1, text="a")]))], 0)
    os.remove(f"{path}/ledger/r-000000000.json")
    os.rename(f"{path}/delivered/r-000000000-000000.jsonl", f"{path}/delivered/r-000000001-000000.jsonl")
    writer.commit([writer.write(iter([Row(id=2, text="b")]))], 0)
    assert rows_of(spark, path) == [(2, "b")]
    writer.commit([writer.write(iter([Row(id=3, text="c")]))], 1)
    assert rows_of(spark, path) == [(2, "b"), (3, "c")]


def test_a_stream_delivered_again(spark, tmp_path):
    sink.register(spark)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"id": {i}, "text": "t{i}"}}\n{{"id": {10 + i}}}\n')
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in order of their times
    path = str(tmp_path / "sink")
    for n in ("a", "b", "b"):  # b: a lost checkpoint, then one that knows all
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.format("delivery_files").option("path", path).option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark, path) == sorted([(i, f"t{i}") for i in range(3)] + [(10 + i, None) for i in range(3)], key=lambda r: r[0])
    assert len(os.listdir(f"{path}/ledger")) == 3 and pending(path) == []
