import io
import json
import subprocess
import sys
import threading
import urllib.error
import urllib.request
from collections import Counter
from unittest.mock import MagicMock

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.operators import (
    chat_completions,
    chat_outcomes,
    completed,
    conversation_requests,
    failed,
    http_client,
    journaled_completions,
    keep_alive_client,
    single_turn_requests,
)
from millrace.operators.chat import with_back_off
from millrace.shared import materialize


def test_single_turn(spark):
    questions = spark.createDataFrame(
        [(1, "How many rows has the table?", None), (2, "Hi", "system"), (3, None, "user")],
        "id int, question string, role string",
    )
    bodies = {r.id: json.loads(r.request) for r in single_turn_requests(questions).collect()}
    assert bodies[1] == {
        "messages": [{"role": "user", "content": "How many rows has the table?"}],
        "parameters": {"max_new_tokens": 400},
        "stream": False,
    }
    assert bodies[2]["messages"][0]["role"] == "system"
    assert bodies[3]["messages"][0]["content"] is None


def test_turns_in_order(spark):
    messages = spark.createDataFrame(
        [(1, t, "user" if t % 2 else "system", f"turn {t}") for t in (10, 2, 1, 11, 9)]
        + [(2, 0, "user", "alone")],
        "conv_id bigint, turn bigint, role string, content string",
    ).repartition(4)
    bodies = {
        r.conv_id: json.loads(r.request)
        for r in conversation_requests(messages, {"temperature": 0}, stream=True).collect()
    }
    assert [m["content"] for m in bodies[1]["messages"]] == [
        "turn 1",
        "turn 2",
        "turn 9",
        "turn 10",
        "turn 11",
    ]
    assert bodies[1]["parameters"] == {"temperature": 0}
    assert bodies[2] == {
        "messages": [{"role": "user", "content": "alone"}],
        "parameters": {"temperature": 0},
        "stream": True,
    }


def test_long_conversation(spark):
    """A third of all messages belong to one conversation."""
    messages = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.col("id").cast("string").alias("content"),
    )
    requests = conversation_requests(messages)
    body = json.loads(requests.filter("conv_id = 0").first().request)
    assert [m["content"] for m in body["messages"]] == [str(i) for i in range(0, 30_000, 3)]
    assert requests.count() == 20_001


def requests_of(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "conv_id int, request string")


def picky_client():
    def connect():
        def answer(body):
            if body == "raise":
                raise ConnectionError("gone")
            if body == "reject":
                return 500, '{"error": "no"}'
            return 200, f'{{"echo": "{body}"}}'

        return answer

    return connect


def test_a_bad_call_fails_alone(spark, rows):
    outcomes = chat_completions(
        requests_of(spark, ["good", "raise", "reject", "fine"]).coalesce(1), picky_client()
    )
    assert rows(outcomes) == [
        (0, 200, '{"echo": "good"}', None),
        (1, None, None, "ConnectionError: gone"),
        (2, 500, None, '{"error": "no"}'),
        (3, 200, '{"echo": "fine"}', None),
    ]
    assert rows(completed(outcomes), "conv_id") == [(0,), (3,)]
    assert rows(failed(outcomes), "conv_id") == [(1,), (2,)]
    assert rows(chat_outcomes(outcomes)) == [("failed", 2), ("ok", 2)]


def test_only_failures(spark, rows):
    outcomes = chat_completions(requests_of(spark, ["raise"]), picky_client())
    assert rows(chat_outcomes(outcomes)) == [("failed", 1)]


def test_other_id_column_and_no_rows(spark):
    requests = requests_of(spark, ["a"]).withColumnRenamed("conv_id", "id")
    outcomes = chat_completions(requests, picky_client(), id_column="id")
    assert outcomes.columns == ["id", "status", "response", "error"]
    assert chat_completions(requests.limit(0), picky_client(), id_column="id").count() == 0


def test_one_client_per_partition(spark):
    clients, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def connect():
        clients.add(1)

        def answer(body):
            calls.add(1)
            return 200, body

        return answer

    requests = requests_of(spark, [str(i) for i in range(500)])
    outcomes = chat_completions(requests, connect, parallelism=3)
    assert outcomes.rdd.getNumPartitions() == 3
    stored = materialize(outcomes)
    assert stored.count() == stored.filter("status = 200").count() == 500
    assert calls.value == 500
    assert clients.value == 3


def test_calls_at_once(spark):
    """Four threads of one task meet at a barrier that none could pass alone."""

    def connect():
        barrier = threading.Barrier(4)

        def answer(body):
            barrier.wait(timeout=30)
            return 200, body

        return answer

    requests = requests_of(spark, [str(i) for i in range(20)]).coalesce(1)
    outcomes = chat_completions(requests, connect, parallelism=1, calls_per_task=4).collect()
    assert sorted((r.conv_id, r.status, r.response) for r in outcomes) == [
        (i, 200, str(i)) for i in range(20)
    ]


def test_calls_are_spread_over_the_cores(spark):
    """A thousand requests in one partition: every core of the session makes calls."""

    def connect():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return lambda body: (200, str(part))

    requests = requests_of(spark, [str(i) for i in range(1000)]).coalesce(1)
    parts = chat_completions(requests, connect).groupBy("response").count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in parts) < 200


def test_calls_run_on_workers_without_this_package(tmp_path):
    """The pickled function is run by another Python that cannot import the package."""
    requests = MagicMock()
    sent = requests.select.return_value.repartition.return_value
    sent.schema = StructType([StructField("conv_id", IntegerType())])
    chat_completions(requests, picky_client())
    function = sent.mapInArrow.call_args.args[0]
    (tmp_path / "function").write_bytes(cloudpickle.dumps((function, http_client("u", "k"))))
    worker = f"""
import pickle, sys
import pyarrow as pa
function, connect = pickle.loads(open({str(tmp_path / "function")!r}, "rb").read())
batch = pa.RecordBatch.from_pydict({{"conv_id": [1, 2], "request": ["a", "raise"]}})
results = list(function([batch]))
assert [r.column("status").to_pylist() for r in results] == [[200], [None]], results
assert callable(connect())
assert "millrace" not in sys.modules
"""
    subprocess.run([sys.executable, "-I", "-c", worker], check=True, cwd=tmp_path)


class Reply(io.BytesIO):
    status = 200


def test_http_client(monkeypatch):
    sent = []

    def urlopen(request, timeout):
        sent.append((request, timeout))
        if len(sent) == 2:
            raise urllib.error.HTTPError(
                request.full_url, 429, "Too Many", {}, io.BytesIO(b'{"message":"slow"}')
            )
        return Reply('{"ok": "ü"}'.encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    post = http_client("https://chat.example.com/v1/chat/completions", "secret", timeout=5)()
    assert post('{"é":1}') == (200, '{"ok": "ü"}')
    assert post("{}") == (429, '{"message":"slow"}')
    request, timeout = sent[0]
    assert timeout == 5
    assert request.method == "POST"
    assert request.data == '{"é":1}'.encode()
    assert request.full_url == "https://chat.example.com/v1/chat/completions"
    assert {k.lower(): v for k, v in request.header_items()} == {
        "content-type": "application/json",
        "x-api-key": "secret",
    }


def counting_client(log, fail_at=None):
    """Writes each call to a file of its own; breaks off at one request, as a killed task does."""

    def connect():
        def answer(body):
            import os
            import uuid

            if body == fail_at and not os.path.exists(f"{log}/failed"):
                open(f"{log}/failed", "w").close()
                os._exit(1)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as file:
                file.write(body)
            if body.endswith("7"):
                raise TimeoutError("no answer")
            return (200, f"re {body}") if int(body) % 5 else (422, "no")

        return answer

    return connect


def calls_in(log):
    return Counter(p.read_text() for p in log.iterdir() if p.name != "failed")


def test_a_journal_is_gone_on_from(spark, rows, tmp_path):
    """The job is killed midway; the next one repeats only what was in flight or not yet added."""
    log, journal = tmp_path / "log", tmp_path / "journal"
    log.mkdir()
    requests = requests_of(spark, [str(i) for i in range(60)])
    with pytest.raises(Exception):
        journaled_completions(
            requests, counting_client(log, "31"), str(journal), parallelism=2, commit_every=4
        )
    before = calls_in(log)
    assert len(before) > 8
    outcomes = journaled_completions(
        requests, counting_client(log), str(journal), parallelism=2, commit_every=4
    )
    found = {r.conv_id: (r.status, r.response, r.error) for r in outcomes.collect()}
    assert found == {
        i: (None, None, "TimeoutError: no answer") if i % 10 == 7
        else (200, f"re {i}", None) if i % 5 else (422, None, "no")
        for i in range(60)
    }
    # A call without an answer is made again; of the others few are repeated.
    again = {b: n for b, n in calls_in(log).items() if n > 1 and not b.endswith("7")}
    assert len(again) <= 2 * (4 + 2)
    calls = sum(calls_in(log).values())
    journaled_completions(requests, counting_client(log), str(journal))
    assert sum(calls_in(log).values()) - calls == 6
    some = journaled_completions(requests.filter("conv_id < 3"), counting_client(log), str(journal))
    assert sorted(r.conv_id for r in some.collect()) == [0, 1, 2]


def test_back_off():
    waits, answers = [], [(429, "slow"), (503, "busy"), (200, "ok"), (400, "bad"), *[(500, "x")] * 9]
    import time

    def connect():
        return lambda body: answers.pop(0)

    own, time.sleep = time.sleep, waits.append
    try:
        post = with_back_off(connect, retries=3, first_wait=2.0)()
        assert post("a") == (200, "ok")
        assert [1 <= waits[0] <= 2, 2 <= waits[1] <= 4] == [True, True]
        assert post("b") == (400, "bad") and len(waits) == 2
        assert post("c") == (500, "x") and len(waits) == 5 and len(answers) == 5
    finally:
        time.sleep = own


def test_a_connection_is_kept(monkeypatch):
    """One connection per thread; one that the service closed is opened anew."""
    import http.client

    made = []

    class Connection:
        def __init__(self, host, timeout):
            self.host, self.sent, self.closed = host, [], False
            made.append(self)

        def request(self, method, target, body, headers):
            assert (method, target) == ("POST", "/v1/chat?x=1")
            assert headers == {"Content-Type": "application/json", "x-api-key": "not in the job"}
            self.sent.append(body)

        def getresponse(self):
            if len(made) == 1 and len(self.sent) == 3:
                raise http.client.RemoteDisconnected("closed")
            return type("R", (), {"status": 200, "read": lambda s: "ü".encode()})()

        def close(self):
            self.closed = True

    monkeypatch.setattr(http.client, "HTTPSConnection", Connection)
    monkeypatch.setenv("OWN_KEY", "not in the job")
    url = "https://chat.example.com/v1/chat?x=1"
    connect = keep_alive_client(url, lambda: __import__("os").environ["OWN_KEY"])
    assert b"not in the job" not in cloudpickle.dumps(connect)
    post = connect()
    assert [post("{}") for _ in range(4)] == [(200, "ü")] * 4
    assert len(made) == 2 and made[0].closed and [len(c.sent) for c in made] == [3, 2]
    thread = threading.Thread(target=post, args=("{}",))
    thread.start()
    thread.join()
    assert len(made) == 3
