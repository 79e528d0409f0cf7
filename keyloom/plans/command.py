"""Text commands as plans: a line is parsed to a Command, a Command builds a DataFrame over a Space.

A read gives rows. A write gives the change rows or the answers of its verb; nothing is written by building."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.fields import OPERATORS
from keyloom.model import KEY
from keyloom.operators import atomic, collections, index, predicate, scan, state, vector, write
from keyloom.streaming import feed


@dataclass(frozen=True)
class Command:
    verb: str
    args: dict = field(default_factory=dict)


@dataclass
class Space:
    """What commands read: the state with its tombstones, hash fields, lists, sets, vectors and indexes, the
    time at which they are read, and the version that the next write gets."""

    state: DataFrame
    now_us: int = 0
    version: int = 1
    fields: DataFrame | None = None
    lists: DataFrame | None = None
    sets: DataFrame | None = None
    vectors: DataFrame | None = None
    catalog: index.Catalog = field(default_factory=index.Catalog)

    @property
    def live(self) -> DataFrame:
        return state.live(self.state, self.now_us)

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.state.sparkSession.createDataFrame(rows, schema)


def _limit(words: list[str]) -> tuple[int, bool]:
    """(limit, reverse) of a tail [LIMIT n] [REV] in any order."""
    limit, reverse, i = 0, False, 0
    while i < len(words):
        word = words[i].upper()
        if word == "LIMIT" and i + 1 < len(words):
            limit, i = int(words[i + 1]), i + 2
        elif word == "REV":
            reverse, i = True, i + 1
        else:
            raise ValueError(f"unexpected {words[i]!r}")
    return limit, reverse


#: verb -> (least and most words after it, their reading as arguments, the plan over a Space).
_VERBS: dict[str, tuple[int, int | None, Callable[[list[str]], dict], Callable[[Space, dict], DataFrame]]] = {}


def verb(name: str, least: int, most: int | None, read: Callable[[list[str]], dict]):
    def put(plan: Callable[[Space, dict], DataFrame]):
        _VERBS[name] = (least, most, read, plan)
        return plan

    return put


def names(*fields: str) -> Callable[[list[str]], dict]:
    """Words by these names; a name that ends in + is an integer."""
    return lambda words: {f.rstrip("+"): int(w) if f.endswith("+") else w for f, w in zip(fields, words)}


def _open(word: str) -> str:
    """"-" is an open end of a range."""
    return "" if word == "-" else word


def parse(line: str) -> Command:
    """The Command of a line; a malformed one is a ValueError. Blanks divide words; the last word of a verb
    that writes a value is the rest of the line."""
    words = line.split()
    if not words:
        raise ValueError("no verb")
    name = words[0].upper()
    if name not in _VERBS:
        raise ValueError(f"unknown verb {words[0]!r}")
    least, most, read, _ = _VERBS[name]
    rest = line.split(None, most)[1:] if name in _VALUED else words[1:]
    if len(rest) < least or most is not None and len(rest) > most:
        raise ValueError(f"{name} takes {least} to {most if most is not None else 'any number of'} arguments")
    return Command(name, read(rest))


def build(space: Space | DataFrame, command: Command) -> DataFrame:
    """The plan of a command; a DataFrame is a space of live rows alone."""
    if isinstance(space, DataFrame):
        space = Space(space)
    return _VERBS[command.verb][3](space, command.args)


def run(space: Space | DataFrame, line: str) -> DataFrame:
    return build(space, parse(line))


#: Verbs whose last argument is the rest of the line.
_VALUED = frozenset("PUT NSPUT SETNX HSET LPUSH RPUSH".split())

# --- reads -----------------------------------------------------------------------------------------------

verb("GET", 1, 1, names("key"))(lambda s, a: scan.get(s.live, "", a["key"]))
verb("NSGET", 2, 2, names("ns", "key"))(lambda s, a: scan.get(s.live, a["ns"], a["key"]))
verb("EXISTS", 1, 1, names("key"))(lambda s, a: scan.get(s.live, "", a["key"]).agg((F.count(F.lit(1)) > 0).alias("found")))
verb("TTL", 1, 1, names("key"))(lambda s, a: s.state.where((F.col("ns") == "") & (F.col("key") == a["key"])).select("key", state.ttl_remaining(s.now_us).alias("ttl")))
verb("RANGE", 2, 5, lambda w: dict(zip(("limit", "reverse"), _limit(w[2:]))) | {"start": _open(w[0]), "end": _open(w[1])})(
    lambda s, a: scan.range_scan(s.live, a["start"], a["end"], a["limit"], a["reverse"])
)
verb("SCANCUR", 2, 3, lambda w: {"cursor": _open(w[0]), "limit": int(w[1]), "ns": w[2] if len(w) > 2 else None})(
    lambda s, a: scan.scan_cursor(s.live, a["cursor"], a["limit"], a["ns"])[0]
)
verb("NSSCAN", 1, 3, lambda w: {"ns": w[0], "prefix": w[1] if len(w) > 1 else "", "limit": int(w[2]) if len(w) > 2 else 0})(
    lambda s, a: scan.ns_scan(s.live, a["ns"], a["prefix"], a["limit"])
)
verb("NSLIST", 0, 0, names())(lambda s, a: scan.namespaces(s.live))
verb("KEYS", 0, 1, lambda w: {"prefix": w[0] if w else ""})(lambda s, a: scan.keys(s.live, a["prefix"]))
verb("COUNT", 0, 0, names())(lambda s, a: s.live.agg(F.count(F.lit(1)).alias("keys")))
verb("VERSION", 1, 1, names("key"))(lambda s, a: atomic.key_version(s.live, s.rows([("", a["key"])], "ns string, key string")))
verb("PSCAN", 1, 3, lambda w: {"name": w[0], "prefix": _open(w[1]) if len(w) > 1 else "", "limit": int(w[2]) if len(w) > 2 else 0})(
    lambda s, a: predicate.predicate_scan(s.live, a["name"], a["prefix"], a["limit"])
)
verb("CHANGES", 2, 2, names("since+", "limit+"))(lambda s, a: feed.changes_since(s.state, a["since"], a["limit"], s.now_us)[0])
verb("IDXLIST", 0, 0, names())(lambda s, a: s.rows(s.catalog.list(), "name string, field string"))
verb("IDXGET", 2, 3, lambda w: {"name": w[0], "value": w[1], "limit": int(w[2]) if len(w) > 2 else 0})(
    lambda s, a: index.lookup(s.catalog.entries(s.live), a["name"], a["value"], a["limit"])
)
verb("HGET", 2, 2, names("key", "field"))(lambda s, a: collections.hget(s.fields, a["key"], a["field"], s.now_us))
verb("HGETALL", 1, 1, names("key"))(lambda s, a: collections.hgetall(s.fields, a["key"], s.now_us))
verb("HKEYS", 1, 1, names("key"))(lambda s, a: collections.hkeys(s.fields, a["key"], s.now_us))
verb("HLEN", 1, 1, names("key"))(lambda s, a: collections.hlen(s.fields.where(F.col("key") == a["key"]), s.now_us))
verb("HTTL", 2, 2, names("key", "field"))(lambda s, a: collections.httl(s.fields, s.now_us).where((F.col("key") == a["key"]) & (F.col("field") == a["field"])))
verb("LRANGE", 3, 3, names("key", "start+", "stop+"))(lambda s, a: collections.lrange(s.lists.where(F.col("key") == a["key"]), a["start"], a["stop"]))
verb("LLEN", 1, 1, names("key"))(lambda s, a: collections.llen(s.lists.where(F.col("key") == a["key"])))
verb("SMEMBERS", 1, 1, names("key"))(lambda s, a: collections.smembers(s.sets, a["key"]))
verb("SCARD", 1, 1, names("key"))(lambda s, a: collections.scard(s.sets.where(F.col("key") == a["key"])))
verb("SISMEMBER", 2, 2, names("key", "member"))(lambda s, a: collections.sismember(s.sets, s.rows([(a["key"], a["member"])], "key string, member string")))
verb("VSEARCH", 3, None, lambda w: {"ns": w[0], "k": int(w[1]), "vec": [float(x) for x in w[2:]]})(
    lambda s, a: vector.search(s.vectors, a["vec"], a["k"], a["ns"])
)


@verb("MGET", 1, None, lambda w: {"keys": w})
def _(s: Space, a: dict) -> DataFrame:
    rows = [(i, "", k) for i, k in enumerate(a["keys"])]
    return scan.mget(s.live, s.rows(rows, "pos long, ns string, key string"), len(rows))


@verb("PFILTER", 2, None, lambda w: {"name": w[0], "keys": w[1:]})
def _(s: Space, a: dict) -> DataFrame:
    rows = [(i, "", k) for i, k in enumerate(a["keys"])]
    return predicate.predicate_filter(s.live, s.rows(rows, "pos long, ns string, key string"), a["name"])


def _query(words: list[str]) -> dict:
    if len(words) not in (5, 7) or words[1].upper() != "WHERE":
        raise ValueError("QUERY ns WHERE field op value [LIMIT n]")
    if words[3] not in OPERATORS:
        raise ValueError(f"unknown operator {words[3]!r}")
    return {"ns": words[0], "field": words[2], "op": words[3], "operand": words[4], "limit": _limit(words[5:])[0]}


verb("QUERY", 5, 7, _query)(lambda s, a: predicate.query_ns(s.live, a["ns"], a["field"], a["op"], a["operand"], a["limit"]))

# --- writes: change rows, or answers where the verb has some --------------------------------------------


def _put(s: Space, ns: str, key: str, value: str, ttl_s: int = 0) -> DataFrame:
    asked = s.rows([(0, ns, key, value, ttl_s)], "pos long, ns string, key string, value string, ttl_s int")
    return write.put(asked, s.now_us, s.version)


def _delete(s: Space, ns: str, keys: list[str]) -> DataFrame:
    asked = s.rows([(i, ns, k) for i, k in enumerate(keys)], "pos long, ns string, key string")
    return write.delete(asked, s.live, s.now_us, s.version)[0]


def _add(s: Space, key: str, delta: int) -> DataFrame:
    asked = s.rows([(0, "", key, delta)], "pos long, ns string, key string, delta long")
    return atomic.increment(asked, s.live) if delta >= 0 else atomic.decrement(asked.withColumn("delta", -F.col("delta")), s.live)


verb("PUT", 2, 2, names("key", "value"))(lambda s, a: _put(s, "", a["key"], a["value"]))
verb("PUTEX", 3, 3, names("key", "value", "ttl+"))(lambda s, a: _put(s, "", a["key"], a["value"], a["ttl"]))
verb("NSPUT", 3, 3, names("ns", "key", "value"))(lambda s, a: _put(s, a["ns"], a["key"], a["value"]))
verb("DEL", 1, None, lambda w: {"keys": w})(lambda s, a: _delete(s, "", a["keys"]))
verb("NSDEL", 2, None, lambda w: {"ns": w[0], "keys": w[1:]})(lambda s, a: _delete(s, a["ns"], a["keys"]))
verb("NSDROP", 1, 1, names("ns"))(lambda s, a: scan.drop_namespace(s.live, a["ns"], s.now_us, s.version))
verb("INCR", 1, 2, lambda w: {"key": w[0], "delta": int(w[1]) if len(w) > 1 else 1})(lambda s, a: _add(s, a["key"], a["delta"]))
verb("DECR", 1, 2, lambda w: {"key": w[0], "delta": -int(w[1]) if len(w) > 1 else -1})(lambda s, a: _add(s, a["key"], a["delta"]))
verb("CAS", 3, 3, names("key", "expected", "new"))(
    lambda s, a: atomic.compare_and_swap(s.rows([(0, "", a["key"], a["expected"], a["new"])], "pos long, ns string, key string, expected string, new string"), s.live)
)
verb("SETNX", 2, 2, names("key", "value"))(
    lambda s, a: atomic.set_if_absent(s.rows([(0, "", a["key"], a["value"])], "pos long, ns string, key string, value string"), s.live)
)
verb("HSET", 3, 3, names("key", "field", "value"))(
    lambda s, a: collections.hset(s.fields, s.rows([(0, a["key"], a["field"], a["value"])], "pos long, key string, field string, value string"), s.now_us)[0]
)
verb("HDEL", 2, None, lambda w: {"key": w[0], "fields": w[1:]})(
    lambda s, a: collections.hdel(s.fields, s.rows([(a["key"], f) for f in a["fields"]], "key string, field string"), s.now_us)[0]
)
verb("HEXPIRE", 3, 3, names("key", "field", "ttl+"))(lambda s, a: collections.hexpire(s.fields, a["key"], a["field"], a["ttl"], s.now_us))
verb("SADD", 2, None, lambda w: {"key": w[0], "members": w[1:]})(
    lambda s, a: collections.sadd(s.sets, s.rows([(i, a["key"], m) for i, m in enumerate(a["members"])], "pos long, key string, member string"))
)
verb("SREM", 2, None, lambda w: {"key": w[0], "members": w[1:]})(
    lambda s, a: collections.srem(s.sets, s.rows([(a["key"], m) for m in a["members"]], "key string, member string"))
)


def _push(s: Space, op: str, key: str, value: str) -> DataFrame:
    """The list's rows and the new one at its end."""
    mine = s.lists.where(F.col("key") == key)
    seq = F.coalesce(F.min("seq") - 1, F.lit(-1)) if op == "LPUSH" else F.coalesce(F.max("seq") + 1, F.lit(0))
    return mine.select("key", "seq", "value").unionByName(mine.agg(seq.cast("long").alias("seq")).select(F.lit(key).alias("key"), "seq", F.lit(value).alias("value")))


def _pop(s: Space, op: str, key: str) -> DataFrame:
    """The item at the list's end, as it leaves."""
    mine = s.lists.where(F.col("key") == key)
    return mine.orderBy(F.asc("seq") if op == "LPOP" else F.desc("seq")).limit(1).select("key", "seq", "value")


for _op in ("LPUSH", "RPUSH"):
    verb(_op, 2, 2, names("key", "value"))(lambda s, a, op=_op: _push(s, op, a["key"], a["value"]))
for _op in ("LPOP", "RPOP"):
    verb(_op, 1, 1, names("key"))(lambda s, a, op=_op: _pop(s, op, a["key"]))


@verb("MPUT", 2, None, lambda w: {"pairs": list(zip(w[::2], w[1::2], strict=True))})
def _(s: Space, a: dict) -> DataFrame:
    asked = s.rows([(i, "", k, v) for i, (k, v) in enumerate(a["pairs"])], "pos long, ns string, key string, value string")
    return write.put(asked, s.now_us, s.version)


@verb("IDXCREATE", 2, 2, names("name", "field"))
def _(s: Space, a: dict) -> DataFrame:
    """The new index's entries over the live rows."""
    s.catalog.create(a["name"], a["field"])
    return s.catalog.entries(s.live).where(F.col("rule") == a["name"])


@verb("IDXDROP", 1, 1, names("name"))
def _(s: Space, a: dict) -> DataFrame:
    """The entries that are left."""
    s.catalog.drop(a["name"])
    return s.catalog.entries(s.live)


@verb("TXN", 1, None, lambda w: {"steps": [x.split(":") for x in w]})
def _(s: Space, a: dict) -> DataFrame:
    """TXN SET:key:value DEL:key SETIF:key:value:version ... as one transaction."""
    rows = []
    for i, (op, key, *rest) in enumerate(a["steps"]):
        op = op.upper()
        if op not in ("SET", "DEL", "SETIF") or len(rest) != {"SET": 1, "DEL": 0, "SETIF": 2}[op]:
            raise ValueError(f"no step of a transaction: {':'.join([op, key, *rest])}")
        rows.append((1, i, op, "", key, rest[0] if rest else None, int(rest[1]) if len(rest) > 1 else None))
    ops = s.rows(rows, "txn_id long, pos int, op string, ns string, key string, value string, expected_version long")
    return atomic.commit(ops, s.live.select(*KEY, "ts_us"))
