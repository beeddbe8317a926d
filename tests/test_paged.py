"""A folder of pages as a batch and a stream source: whole, filtered in the store, gone on with after a restart."""

import json
import sys

import pytest
from pyspark import cloudpickle

from folioscope.sources import paged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class FolderPages:
    """Files of JSON lines, one for each page; notes what it gives away."""

    def __init__(self, path):
        self.path = path

    def pages(self):
        import os

        return len([n for n in os.listdir(self.path) if n.endswith(".page")])

    def columns(self):
        return ["kind"]

    def page(self, number, equal):
        given = 0
        with open(f"{self.path}/{number}.page") as f:
            for line in f:
                row = json.loads(line)
                if all(row[c] in values for c, values in equal.items()):
                    given += 1
                    yield (row["id"], row["kind"], row["text"])
        with open(f"{self.path}/given", "a") as f:
            f.write(f"{number} {given}\n")


def put(path, number, ids):
    (path / f"{number}.page").write_text("".join(json.dumps({"id": i, "kind": "ab"[i % 2], "text": None if i == 3 else f"t{i}"}) + "\n" for i in ids))


@pytest.fixture
def folder(spark, tmp_path):
    path = tmp_path / "pages"
    path.mkdir()
    paged.register(spark, "folder_pages", "id bigint, kind string, text string", FolderPages(str(path)))
    return path


def test_batch(spark, folder):
    read = spark.read.format("folder_pages").load()
    assert read.count() == 0
    for n in range(4):
        put(folder, n, range(10 * n, 10 * n + 10))
    read = spark.read.format("folder_pages").load()
    assert sorted(r.id for r in read.collect()) == list(range(40)) and read.rdd.getNumPartitions() == 4
    assert [r.id for r in read.where("text is null").collect()] == [3]
    (folder / "given").unlink()
    some = spark.read.format("folder_pages").load().where("kind = 'a' and id > 15")
    assert sorted(r.id for r in some.collect()) == list(range(16, 40, 2))
    # the store gave only rows of that kind, and the plan tests the rest alone
    assert sorted((folder / "given").read_text().split("\n")[:-1]) == [f"{n} 5" for n in range(4)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "id" in plan.split("Filter")[1] and "= a" not in plan.split("Filter")[1].split("BatchScan")[0]


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        q = spark.readStream.format("folder_pages").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
        return sorted(r.id for r in spark.read.parquet(out).collect())

    put(folder, 0, range(5))
    put(folder, 1, range(5, 8))
    assert run() == list(range(8))
    put(folder, 2, range(8, 12))
    (folder / "given").unlink()
    assert run() == list(range(12))
    assert (folder / "given").read_text() == "2 4\n"
