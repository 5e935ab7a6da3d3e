"""Chat completions over tables: build request bodies, call a service, count the outcomes."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from millrace.functions.chat import DEFAULT_PARAMETERS, DEFAULT_ROLE, message, request_body
from millrace.shared import Folder, materialize
from millrace.sources.stores import opener, session_place

#: Sends one request body and returns the HTTP status and the response body.
Client = Callable[[str], tuple[int, str]]


def single_turn_requests(
    questions: DataFrame,
    parameters: Mapping[str, object] = DEFAULT_PARAMETERS,
    stream: bool = False,
) -> DataFrame:
    """One request per row of ``id, question, role``; a null role is the user's."""
    role = F.coalesce("role", F.lit(DEFAULT_ROLE))
    return questions.select(
        "id", request_body(message(role, "question"), parameters, stream).alias("request")
    )


def conversation_requests(
    messages: DataFrame,
    parameters: Mapping[str, object] = DEFAULT_PARAMETERS,
    stream: bool = False,
) -> DataFrame:
    """One request per conversation from ``conv_id, turn, role, content``, in turn order.

    Messages become JSON before the shuffle, wherever they are read. What is left for a group
    is to put them in order and join them to its body, which is one string of one row: a
    conversation can be no longer than a request body may be.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "message")))
    ordered = F.array_join(F.transform(turns, lambda turn: turn["message"]), ",")
    return (
        messages.select("conv_id", "turn", message("role", "content").alias("message"))
        .groupBy("conv_id")
        .agg(request_body(ordered, parameters, stream).alias("request"))
    )


def http_client(url: str, api_key: str, timeout: float = 300.0) -> Callable[[], Client]:
    """A client factory that posts bodies to ``url`` with the key in the ``x-api-key`` header."""

    def connect() -> Client:
        def post(body: str) -> tuple[int, str]:
            request = urllib.request.Request(
                url,
                data=body.encode(),
                headers={"Content-Type": "application/json", "x-api-key": api_key},
                method="POST",
            )
            try:
                with urllib.request.urlopen(request, timeout=timeout) as response:
                    return response.status, response.read().decode()
            except urllib.error.HTTPError as error:
                return error.code, error.read().decode(errors="replace")

        return post

    return connect


def keep_alive_client(
    url: str, api_key: Callable[[], str], timeout: float = 300.0
) -> Callable[[], Client]:
    """As :func:`http_client`, with one connection per thread that is used again.

    ``api_key`` gives the key where the calls are made, for example from the worker's environment,
    so that the key is no part of the job. A connection that the service has closed meanwhile is
    opened anew, once per call.
    """

    def connect() -> Client:
        import http.client
        import threading
        from urllib.parse import urlsplit

        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        headers = {"Content-Type": "application/json", "x-api-key": api_key()}
        own = threading.local()

        def post(body: str) -> tuple[int, str]:
            known = hasattr(own, "connection")
            for last in (False, True) if known else (True,):
                if not hasattr(own, "connection"):
                    own.connection = kind(parts.netloc, timeout=timeout)
                try:
                    own.connection.request("POST", target, body.encode(), headers)
                    answer = own.connection.getresponse()
                    return answer.status, answer.read().decode(errors="replace")
                except (http.client.RemoteDisconnected, ConnectionError):
                    own.connection.close()
                    del own.connection
                    if last:
                        raise
                except BaseException:
                    own.connection.close()
                    del own.connection
                    raise

        return post

    return connect


def with_back_off(
    client_factory: Callable[[], Client], retries: int = 5, first_wait: float = 1.0
) -> Callable[[], Client]:
    """A client that calls again after status 429 or 5xx, each time after twice the wait."""

    def connect() -> Client:
        import random
        import time

        client = client_factory()

        def post(body: str) -> tuple[int, str]:
            for turn in range(retries + 1):
                status, answer = client(body)
                if turn == retries or not (status == 429 or 500 <= status < 600):
                    return status, answer
                # Spread, so that callers that were refused together don't come back together.
                time.sleep(first_wait * 2**turn * (0.5 + random.random() / 2))
            raise AssertionError("unreachable")

        return post

    return connect


def journaled_completions(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    journal: str,
    parallelism: int | None = None,
    calls_per_task: int = 1,
    commit_every: int = 100,
    id_column: str = "conv_id",
) -> DataFrame:
    """:func:`chat_completions`, with a journal that a job which broke off goes on from.

    ``journal`` is a folder that all workers reach. A task adds the outcomes of its calls there,
    ``commit_every`` at a time, each in a file of its own; the next job sends only requests
    whose id has no outcome with an answer of the service yet. So after a job that was killed, calls are
    repeated that were in flight or had not been added: ``commit_every`` and
    ``2 * calls_per_task`` per task at most. Requests are told apart by their id, which is not null.

    The calls are made when this is called. Returns the outcomes of the given requests, one per id, from the
    journal; where a lost executor's task ran twice, one of its outcomes that has a status.
    """
    spark = requests.sparkSession
    place = session_place(spark, journal)
    if place is None or place["scheme"] != "file":
        add = _arrow_adder(place)
    else:
        add = _file_adder(place["base"])
    Folder(spark, journal).make()
    id_type = requests.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, status int, response string, error string"

    def held() -> DataFrame:
        return spark.read.schema(schema).json(journal)

    wanted = requests.select(id_column, "request")
    open_ = wanted.join(held().filter("status is not null").select(id_column), id_column, "left_anti")
    if parallelism is None:
        parallelism = spark.sparkContext.defaultParallelism
    call = _caller(client_factory, calls_per_task, id_column)

    # Calls and journal in one function: between two of them Spark would gather outcomes first.
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        rows: list[str] = []
        for batch in call(batches):
            for row in batch.to_pylist():
                rows.append(json.dumps(row))
                if len(rows) >= commit_every:
                    add("\n".join(rows) + "\n")
                    rows = []
        if rows:
            add("\n".join(rows) + "\n")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    sent = materialize(open_).repartition(parallelism)
    sent.mapInArrow(keep, "n long").write.format("noop").mode("overwrite").save()
    best = F.max(F.struct(F.col("status").isNotNull().alias("known"), "status", "response", "error"))
    found = held().groupBy(id_column).agg(best.alias("best"))
    return found.join(wanted.select(id_column).distinct(), id_column, "left_semi").select(
        id_column, "best.status", "best.response", "best.error"
    )


def _file_adder(base: str) -> Callable[[str], None]:
    """Adds a file at once: it is written under a name that readers leave out, then renamed."""

    def add(text: str) -> None:
        import os
        import uuid

        name = uuid.uuid4().hex
        with open(f"{base}/_{name}", "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        os.rename(f"{base}/_{name}", f"{base}/{name}.json")

    return add


def _arrow_adder(place: dict | None) -> Callable[[str], None]:
    """Adds an object, which is there when it is whole."""
    if place is None:
        raise ValueError("No file system here writes the journal")
    open_store = opener(place)

    def add(text: str) -> None:
        import uuid

        store = open_store()
        with store.store.open_output_stream(f"{store.base}/{uuid.uuid4().hex}.json") as file:
            file.write(text.encode())

    return add


def _caller(client_factory: Callable[[], Client], calls_per_task: int, id_column: str) -> Callable:
    """A function from batches of requests to those of their outcomes, in the order of requests."""

    # Nested, so that the whole function travels to workers that lack this package.
    def outcome(client: Client, body: str) -> tuple[int | None, str | None, str | None]:
        try:
            status, answer = client(body)
        except Exception as error:  # whatever a client raises belongs to this request only
            return None, None, f"{type(error).__name__}: {error}"
        return (status, answer, None) if status == 200 else (status, None, answer)

    def call(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()

        def answered(row: pa.RecordBatch, future: Future) -> pa.RecordBatch:
            status, response, error = future.result()
            return pa.RecordBatch.from_arrays(
                [
                    row.column(id_column),
                    pa.array([status], pa.int32()),
                    pa.array([response], pa.string()),
                    pa.array([error], pa.string()),
                ],
                names=[id_column, "status", "response", "error"],
            )

        # A window of calls moves on as the oldest one ends; no more responses are held.
        with ThreadPoolExecutor(calls_per_task) as threads:
            sent: deque = deque()
            for batch in batches:
                for k, body in enumerate(batch.column("request").to_pylist()):
                    if len(sent) >= 2 * calls_per_task:
                        yield answered(*sent.popleft())
                    sent.append((batch.slice(k, 1), threads.submit(outcome, client, body)))
            while sent:
                yield answered(*sent.popleft())

    return call


def chat_completions(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    parallelism: int | None = None,
    calls_per_task: int = 1,
    id_column: str = "conv_id",
) -> DataFrame:
    """Send every request and return ``id, status, response, error``, one row per request.

    Status 200 fills ``response`` with the body as received, any other status fills ``error``
    with it, and an exception leaves the status null, so a bad call fails only its own row.
    Each partition makes one client. ``parallelism`` partitions (as many as the session has
    cores, unless given) with ``calls_per_task`` threads each bound the calls in flight; with more than one thread they share the client. Every
    action on the result calls the service again: write it to a table and work from there.
    """
    if parallelism is None:
        parallelism = requests.sparkSession.sparkContext.defaultParallelism
    # A given number of partitions is kept by adaptive execution, however small they are.
    requests = requests.select(id_column, "request").repartition(parallelism)
    schema = StructType(
        [
            requests.schema[id_column],
            StructField("status", IntegerType()),
            StructField("response", StringType()),
            StructField("error", StringType()),
        ]
    )

    return requests.mapInArrow(_caller(client_factory, calls_per_task, id_column), schema)


def completed(outcomes: DataFrame) -> DataFrame:
    """The outcomes with a response."""
    return outcomes.filter("status <=> 200")


def failed(outcomes: DataFrame) -> DataFrame:
    """The outcomes without a response: another status, or none at all."""
    return outcomes.filter("not (status <=> 200)")


def chat_outcomes(outcomes: DataFrame) -> DataFrame:
    """Count the outcomes as ``status_class, n``, with the classes ok and failed."""
    status_class = F.when(F.col("status").eqNullSafe(200), "ok").otherwise("failed")
    return outcomes.groupBy(status_class.alias("status_class")).agg(F.count("*").alias("n"))
