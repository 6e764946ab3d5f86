"""Actions as data: a trace is a list of action dictionaries, in columns an ARRAY<STRUCT>.

Combinators build traces on the driver (``then``, ``product``, ``either``); keys and dry runs are pure functions of a trace, and the
names that results are exported under are not part of the key.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.parse
from base64 import b64encode
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_TYPE = "array<struct<op:string,uri:string,name:string,method:string,entity:string>>"
Action = dict[str, str | None]
Trace = list[Action]

#: Operations that yield a document, that only change the state of a session, and that need a session at all.
EXPORTS = {"get", "post", "snapshot", "screenshot", "mock"}
STATE_CHANGES = {"visit", "click", "click_next", "submit", "text_input", "select_option", "to_frame", "script", "drag"}
SESSION = STATE_CHANGES | {"snapshot", "screenshot", "wait_for", "wait_ready"}


def action(op: str, uri: str | None = None, name: str | None = None, method: str | None = None, entity: str | None = None) -> Action:
    return {"op": op, "uri": uri, "name": name, "method": method, "entity": entity}


def get(uri: str, name: str | None = None) -> Trace:
    return [action("get", repair_uri(uri), name, "GET")]


def post(uri: str, entity: str, name: str | None = None) -> Trace:
    return [action("post", repair_uri(uri), name, "POST", entity)]


def mock(text: str, name: str | None = None) -> Trace:
    return [action("mock", None, name, None, text)]


def delay(seconds: float) -> Trace:
    return [action("delay", entity=str(seconds))]


def random_delay(least: float, most: float) -> Trace:
    return [action("delay", entity=f"{least}:{most}")]


def loop(trace: Trace, limit: int = 16) -> Trace:
    """The trace again and again until an action fails, at most ``limit`` times."""
    return [action("loop", entity=json.dumps({"trace": trace, "limit": limit}))]


def local_retry(trace: Trace, times: int = 3) -> Trace:
    """The trace from its start after a failure, at most ``times`` attempts in one session."""
    return [action("retry", entity=json.dumps({"trace": trace, "times": times}))]


def flat(trace: Trace) -> Trace:
    """Loops and retries replaced by the actions in them, once."""
    return [b for a in trace for b in (flat(json.loads(a["entity"])["trace"]) if a["op"] in ("loop", "retry") else [a])]


def named(trace: Trace, name: str) -> Trace:
    return [*trace[:-1], trace[-1] | {"name": name}] if trace else trace


def then(*traces: Trace) -> Trace:
    return [a for t in traces for a in t]


def product(left: list[Trace], right: list[Trace]) -> list[Trace]:
    """Every trace of left followed by every trace of right."""
    return [then(a, b) for a in left for b in right]


def either(*options: list[Trace]) -> list[Trace]:
    """All traces once, in order."""
    out: list[Trace] = []
    for t in (t for o in options for t in o):
        if t not in out:
            out.append(t)
    return out


def dry_run(trace: Trace) -> list[Trace]:
    """For each document the trace will yield, the actions it depends on; those without a session depend on themselves alone."""
    trace = flat(trace)
    return [[a] if a["op"] not in SESSION else [b for b in trace[: i + 1] if b["op"] in SESSION] for i, a in enumerate(trace) if a["op"] in EXPORTS]


def state_changes(trace: Trace) -> Trace:
    return [a for a in flat(trace) if a["op"] in STATE_CHANGES]


def trace_key_of(trace: Trace) -> str:
    return hashlib.sha256(json.dumps([[a["op"], a["uri"], a["method"], a["entity"]] for a in trace]).encode()).hexdigest()


def repair_uri(uri: str) -> str:
    """Percent-encodes what a malformed URI must not hold; what is already encoded stays."""
    return urllib.parse.quote(uri.strip(), safe="%/:=&?~#+!$,;'@()*[]")


def oauth_sign(uri: str, consumer: str, secret: str, token: str = "", token_secret: str = "", now: int | None = None, nonce: str = "0") -> str:
    """The URI with an HMAC-SHA1 signature of its GET request; signed URIs are not cached."""
    base, _, query = uri.partition("?")
    params = dict(urllib.parse.parse_qsl(query, keep_blank_values=True)) | {
        "oauth_consumer_key": consumer, "oauth_nonce": nonce, "oauth_signature_method": "HMAC-SHA1", "oauth_timestamp": str(now if now is not None else int(time.time())), "oauth_version": "1.0",
    }
    if token:
        params["oauth_token"] = token
    quote = lambda s: urllib.parse.quote(s, safe="-._~")
    flat = "&".join(f"{quote(k)}={quote(v)}" for k, v in sorted(params.items()))
    mac = hmac.new(f"{quote(secret)}&{quote(token_secret)}".encode(), "&".join(["GET", quote(base), quote(flat)]).encode(), hashlib.sha1)
    return f"{base}?{flat}&oauth_signature={quote(b64encode(mac.digest()).decode())}"


def cache_level(uri: Column) -> Column:
    """``all`` for web addresses, else ``memory``."""
    return F.when(F.lower(F.split(uri, ":")[0]).isin("http", "https", "ftp", "ftps"), "all").otherwise("memory")


def get_column(uri: Column, name: str | None = None) -> Column:
    """A one-action trace for each row."""
    fields = [F.lit("get").alias("op"), uri.alias("uri"), F.lit(name).cast("string").alias("name"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("entity")]
    return F.array(F.struct(*fields)).cast(TRACE_TYPE)


def trace_key(trace: Column) -> Column:
    """Hash of a trace without its names."""
    return F.sha2(F.to_json(F.transform(trace, lambda a: F.struct(a["op"].alias("o"), a["uri"].alias("u"), a["method"].alias("m"), a["entity"].alias("e")))), 256)


def retried(run: Callable[[], object], times: int, wait: float = 0.0) -> object:
    """The first success; the last failure after ``times`` attempts."""
    for left in range(times - 1, -1, -1):
        try:
            return run()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("at least one attempt is needed")


def looped(run: Callable[[int], object], limit: int = 16) -> list[object]:
    """Results until the first failure, at most ``limit``; what was found is kept."""
    out: list[object] = []
    for i in range(limit):
        try:
            out.append(run(i))
        except Exception:
            break
    return out
