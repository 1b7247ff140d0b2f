"""What the operators share: Arrow kernels, caches in worker processes, span digests."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

import skylode

# Workers need no copy of the package: kernels travel with their code.
cloudpickle.register_pickle_by_value(skylode)

BATCH_BYTES = 8 << 20


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """One value for each worker process, made on first use and kept over tasks."""
    store = sys.modules.setdefault("_skylode_worker", types.ModuleType("_skylode_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def tokenizer_text(path: str) -> tuple[str, str]:
    """A tokenizer file's text, read on the driver and sent with the kernel (a few MB, whatever the input), and a name for what is made of it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, hashlib.sha256(text.encode()).hexdigest()


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in bytes, so long texts can't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column of texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


#: Salts that the rows of one key are dealt to in a join.
SALTS = 16


def salt(by: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def salts_of(own: Column) -> Column:
    """An aggregate: the salts that the rows of a group have, as bits (63 at most)."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), own))


def each_salt(bits: str, salts: int = SALTS) -> Column:
    """A row for each salt that ``bits`` names. Joined by key and salt, the rows of a hot key meet their one partner in as many tasks."""
    has = lambda s: F.call_function("shiftright", F.col(bits), s).bitwiseAND(F.lit(1)) == 1
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), has))


def _hashable(kind: DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return not isinstance(kind, MapType) and kind.typeName() != "variant" and all(map(_hashable, parts))


def keep_rows(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each ``key`` in ``wanted``; of several rows with a key that with the least hash of its columns.

    Rows of a key meet in the map side first, and the join finds them dealt by the key already.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[c for c, f in zip(columns, docs.schema, strict=True) if _hashable(f.dataType)])
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), order.alias("order"))
    return rows.groupBy("key").agg(F.min_by("row", "order").alias("row")).join(wanted.select("key"), "key", "left_semi").select("row.*")


#: Items that a scan takes at a time.
CHUNK = 128


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once, however often ``body`` names it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def scanned(items: str, zero: str, step: str, emit: str, kind: str) -> str:
    """SQL: a fold over an array that also gives a value of type ``kind`` for each item, as a struct (state, out).

    ``step`` makes the next state of a state ``s_.state`` and an item ``x``, ``emit`` the value. A fold copies its state with each step, so a
    list that grows inside one costs the square of its length. Here an inner fold gathers the values of a chunk, and an outer one those of the chunks.
    SQL text, as a plan of some thousand nodes is parsed faster than it is put together call by call.
    """
    inner = f"named_struct('state', {step}, 'part', concat(s_.part, array({emit})))"
    one = f"(s_, x) -> {inner}"
    chunk = f"(acc, part) -> aggregate(part, named_struct('state', acc.state, 'part', cast(array() as array<{kind}>)), {one}, r -> named_struct('state', r.state, 'done', concat(acc.done, array(r.part))))"
    chunks = f"transform(sequence(1, greatest(size(own), 1), {CHUNK}), i -> slice(own, i, {CHUNK}))"
    start = f"named_struct('state', {zero}, 'done', cast(array() as array<array<{kind}>>))"
    return let(items, "own", f"aggregate({chunks}, {start}, {chunk}, r -> named_struct('state', r.state, 'out', flatten(r.done)))")


def free_name(df: DataFrame, wanted: str) -> str:
    """A name that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (wanted + "_" * i for i in range(len(taken) + 1)) if x.lower() not in taken)
