"""Searches that run in the background and outlive the session that has started them.

Each has a folder with its request, its state and its result as Parquet, in a folder that
all machines share; a new session goes on with those that are not done and that no other
session holds: one that runs a search renews its lease of it as long as it lives.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from logweir.operators import aggregate, search
from logweir.operators.table import LogTable

DAY_S = 86_400
#: Seconds for which a session holds a search without a sign of life.
LEASE_S = 60


class Jobs:
    def __init__(self, spark: SparkSession, table: LogTable, root: str, keep_s: int = DAY_S):
        self.spark, self.table, self.root, self.keep_s = spark, table, root, keep_s
        self._threads: dict[str, threading.Thread] = {}
        self._me = str(uuid.uuid4())

    def _claim(self, id_: str) -> bool:
        """Whether the search is this session's now: a lease that is there and not over is another's."""
        held = self._get(id_, "lease")
        p, fs = self._fs(f"{self.root}/{id_}/lease.json")
        if held is not None:
            if held["owner"] != self._me and held["until"] > time.time():
                return False
            fs.delete(p, False)
        try:
            out = fs.create(p, False)  # fails if another session has been faster
        except Exception:
            return False
        out.write(bytearray(json.dumps({"owner": self._me, "until": time.time() + LEASE_S}).encode()))
        out.close()
        return True

    def _renew(self, id_: str, over: threading.Event) -> None:
        while not over.wait(LEASE_S / 3):
            self._put(id_, "lease", {"owner": self._me, "until": time.time() + LEASE_S})

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, id_: str, name: str, value: dict) -> None:
        p, fs = self._fs(f"{self.root}/{id_}/{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, id_: str, name: str) -> dict | None:
        p, fs = self._fs(f"{self.root}/{id_}/{name}.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def start(self, query: str, begin: int | None = None, end: int | None = None, size: int = 0, aggs: list[aggregate.Agg] = (), interval_ms: int = 0, dialect: str = "pipe") -> str:
        """The id of a search that runs from now on."""
        self.table.parse(query, dialect)
        for a in aggs:
            a.check()
        id_ = str(uuid.uuid4())
        request = {"query": query, "begin": begin, "end": end, "size": size, "aggs": [asdict(a) for a in aggs], "interval_ms": interval_ms, "dialect": dialect, "started": time.time()}
        self._put(id_, "request", request)
        self._claim(id_)
        self._run(id_, request)
        return id_

    def _run(self, id_: str, request: dict) -> None:
        over = threading.Event()

        def work() -> None:
            threading.Thread(target=self._renew, args=(id_, over), daemon=True).start()
            self.spark.sparkContext.addJobTag(f"search-{id_}")
            try:
                rows = self.table.select(request["query"], request["begin"], request["end"], request["dialect"])
                if request["size"]:
                    search.page(self.table, rows, request["size"]).write.mode("overwrite").parquet(f"{self.root}/{id_}/docs")
                for i, a in enumerate(request["aggs"]):
                    agg = aggregate.Agg(**(a | {"quantiles": tuple(a["quantiles"])}))
                    aggregate.buckets(self.table, rows, agg).write.mode("overwrite").parquet(f"{self.root}/{id_}/agg{i}")
                if request["interval_ms"]:
                    search.histogram(self.table, rows, request["interval_ms"]).write.mode("overwrite").parquet(f"{self.root}/{id_}/hist")
                state = {"done": True, "error": ""}
            except Exception as e:  # the state tells what failed
                state = {"done": True, "error": str(e)[:2000]}
            over.set()
            if self._get(id_, "state") is None:
                self._put(id_, "state", state)
            p, fs = self._fs(f"{self.root}/{id_}/lease.json")
            fs.delete(p, False)

        self._threads[id_] = threading.Thread(target=work, daemon=True)
        self._threads[id_].start()

    def wait(self, id_: str, seconds: float | None = None) -> None:
        if id_ in self._threads:
            self._threads[id_].join(seconds)

    def state(self, id_: str) -> dict:
        """done, error and the time at which the result expires."""
        request = self._get(id_, "request")
        if request is None:
            raise search.RequestError(f"no search {id_}")
        return (self._get(id_, "state") or {"done": False, "error": ""}) | {"expires": request["started"] + self.keep_s}

    def result(self, id_: str, part: str = "docs") -> DataFrame:
        """``docs``, ``hist`` or ``agg0``, ``agg1`` and so on."""
        state = self.state(id_)
        if not state["done"] or state["error"]:
            raise search.RequestError(state["error"] or f"search {id_} is not done")
        return self.spark.read.parquet(f"{self.root}/{id_}/{part}")

    def cancel(self, id_: str) -> None:
        self._put(id_, "state", {"done": True, "error": "canceled"})
        self.spark.sparkContext.cancelJobsWithTag(f"search-{id_}")

    def resume(self) -> list[str]:
        """Starts what an earlier session has left undone and none holds, and drops what has expired."""
        p, fs = self._fs(self.root)
        own = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        out = []
        for id_ in own:
            request = self._get(id_, "request")
            if request is None:
                continue
            if time.time() > request["started"] + self.keep_s:
                fs.delete(self._fs(f"{self.root}/{id_}")[0], True)
            elif self._get(id_, "state") is None and id_ not in self._threads and self._claim(id_):
                self._run(id_, request)
                out.append(id_)
        return out
