"""Remote documents: fetchers for http(s), ftp and file addresses, and agents that run the actions of a trace in order."""

from __future__ import annotations

import json
import mimetypes
import random
import ssl
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from queue import SimpleQueue
from urllib.parse import urlencode, urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..conf import Conf
from ..errors import ActionFailed
from ..functions import html
from ..plans.actions import EXPORTS, repair_uri, retried
from ..runtime import Session
from .files import package_file, read_bytes, write_bytes

DOC = {"uri": "string", "kind": "string", "error": "string", "content": "string", "mime": "string", "status": "int", "name": "string"}
Agent = Callable[[list[dict]], list[dict]]


def run_trace(trace: list[dict], one: Callable[[dict], dict | None]) -> list[dict]:
    """What the actions of a trace give, in order. ``loop`` repeats its actions until one fails and keeps what it found; ``retry`` starts its
    actions again, and what a failed attempt found is dropped."""
    out: list[dict] = []
    for a in trace:
        if a["op"] == "loop":
            inner = json.loads(a["entity"])
            try:
                for _ in range(inner["limit"]):
                    for b in inner["trace"]:
                        out += run_trace([b], one)
            except Exception:  # the loop's own end
                continue
        elif a["op"] == "retry":
            inner = json.loads(a["entity"])
            out += retried(lambda inner=inner: run_trace(inner["trace"], one), inner["times"])
        else:
            got = one(a)
            if got:
                out.append(got | {"name": a["name"]})
    return out


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Follows redirects of posts too (as gets, or as they are where the status says so), and repairs the addresses it is sent to."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        newurl = repair_uri(newurl)
        if code in (307, 308) and req.data is not None:
            return urllib.request.Request(newurl, data=req.data, headers=dict(req.headers), method=req.get_method())
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def urllib_agent(conf: Conf) -> Agent:
    """Runs get, post, delay and mock, loops and retries of these; others need an agent with a session.

    Addresses of file systems, ``local:`` paths and ``resource:package/path`` are read as they are; ``trust_all`` in the settings accepts any certificate.
    """
    handlers = [urllib.request.ProxyHandler({"http": conf.proxy, "https": conf.proxy})] if conf.proxy else []
    if conf.trust_all:
        handlers.append(urllib.request.HTTPSHandler(context=ssl._create_unverified_context()))
    opener = urllib.request.build_opener(*handlers, _Redirects())
    opener.addheaders = list(conf.headers) or [("User-Agent", "gleaner")]

    def one(a: dict) -> dict | None:
        if a["op"] == "delay":
            low, _, high = a["entity"].partition(":")
            time.sleep(random.uniform(float(low), float(high)) if high else float(low))
            return None
        if a["op"] == "mock":
            return {"content": a["entity"], "mime": "text/plain", "status": 200, "uri": a["uri"]}
        if a["op"] not in ("get", "post"):
            raise ValueError(f"no session for {a['op']}")
        body = (a["entity"] or "").encode() if a["op"] == "post" else None
        scheme = a["uri"].partition(":")[0].lower()
        if scheme not in ("http", "https", "ftp", "ftps"):
            if body is not None:  # a post to a file system writes the entity
                write_bytes(a["uri"], body)
                return None
            raw = package_file(a["uri"]) if scheme == "resource" else read_bytes(a["uri"].removeprefix("local:"))
            return {"content": raw.decode("utf-8", "replace"), "mime": mimetypes.guess_type(a["uri"])[0] or "text/plain", "status": None, "uri": a["uri"]}
        with opener.open(urllib.request.Request(a["uri"], data=body), timeout=conf.remote_timeout) as r:
            raw = r.read()
            charset = r.headers.get_content_charset() or "utf-8"
            return {"content": raw.decode(charset, "replace"), "mime": r.headers.get_content_type(), "status": getattr(r, "status", None), "uri": r.geturl()}

    return lambda trace: run_trace(trace, one)


class _Slot:
    """What a thread of ``Sessions`` is doing: its attempt, when that began, and whether it was given up."""

    __slots__ = ("job", "since", "lost")

    def __init__(self) -> None:
        self.job, self.since, self.lost = None, 0.0, False


class Sessions:
    """Threads that run traces side by side, each with one attempt after another and none of them with a thread for itself.

    An attempt that takes longer than ``limit`` seconds has failed. As nothing can stop its thread, that one is left behind and another takes its place.
    """

    def __init__(self, run: Agent, size: int, limit: float, times: int) -> None:
        self.run, self.limit, self.times = run, limit, times
        self.lock, self.done, self.jobs = threading.Lock(), threading.Event(), SimpleQueue()
        self.slots: list[_Slot] = []
        for _ in range(size):
            self._start()

    def _start(self) -> None:
        self.slots.append(slot := _Slot())
        threading.Thread(target=self._work, args=(slot,), daemon=True).start()

    def _work(self, slot: _Slot) -> None:
        while (job := self.jobs.get()) is not None:
            slot.since, slot.job = time.monotonic(), job
            try:
                got = self.run(job[1])
            except BaseException as e:
                got = e
            with self.lock:
                if slot.lost:
                    return
                slot.job = None
                self._settle(job, got)

    def _settle(self, job: tuple[int, list[dict], int], got: list[dict] | BaseException) -> None:
        i, trace, left = job
        if isinstance(got, Exception) and left > 1:
            self.jobs.put((i, trace, left - 1))
            return
        self.out[i] = got
        self.open -= 1
        if not self.open:
            self.done.set()

    def map(self, traces: list[list[dict]]) -> list[list[dict] | Exception]:
        """What each trace gives, or the failure of its last attempt."""
        if self.times < 1:
            return [ValueError("at least one attempt is needed") for _ in traces]
        if not traces:
            return []
        self.out, self.open = [None] * len(traces), len(traces)
        self.done.clear()
        for i, trace in enumerate(traces):
            self.jobs.put((i, trace, self.times))
        wait = self.limit
        while not self.done.wait(wait):
            with self.lock:
                now = time.monotonic()
                for slot in [x for x in self.slots if x.job is not None and now - x.since >= self.limit]:
                    slot.lost = True
                    self.slots.remove(slot)
                    self._start()
                    self._settle(slot.job, TimeoutError())
                wait = max(0.001, min([self.limit, *(x.since + self.limit - now for x in self.slots if x.job is not None)]))
        for got in self.out:
            if isinstance(got, BaseException) and not isinstance(got, Exception):
                raise got
        return self.out

    def close(self) -> None:
        for _ in self.slots:
            self.jobs.put(None)


def _traces(column: pa.Array) -> list[list[dict]]:
    """A column of traces as Python lists, made a field at a time."""
    flat = column.flatten()
    if column.null_count or flat.null_count:
        return column.to_pylist()
    names = [f.name for f in flat.type]
    steps = [dict(zip(names, x)) for x in zip(*(x.to_pylist() for x in flat.flatten()))]
    ends = pc.cumulative_sum(pc.list_value_length(column)).to_pylist()
    return [steps[a:b] for a, b in zip([0, *ends], ends)]


def agent_fetcher(make_agent: Callable[[], Agent], conf: Conf | None = None, sessions: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that runs each trace with an agent of its partition; failures after all attempts become error rows.

    An attempt that takes longer than the remote timeout and ``hard_timeout_extra`` counts as failed; the session that hangs is left behind.
    """
    conf = conf or Conf()
    limit = conf.remote_timeout + conf.hard_timeout_extra

    def fetcher(share: bool) -> Callable[[DataFrame], DataFrame]:
        def fetch(keys: DataFrame) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                agent = make_agent()
                close = getattr(agent, "close", None)
                last: tuple[str | None, list[dict]] = (None, [])
                pool = Sessions(lambda trace: [d for d in agent(trace) if d.get("content") is not None], sessions, limit, conf.remote_retries)

                def told(trace: list[dict], got: list[dict] | Exception) -> list[dict]:
                    if isinstance(got, Exception):  # told in the row
                        return [{"kind": "error", "error": f"{type(got).__name__}: {got}", "uri": trace[-1]["uri"] if trace else None}]
                    return [{"kind": "doc", "error": None} | d for d in got] or [{"kind": "nodoc"}]

                try:
                    for batch in batches:
                        names = batch.column("_trace_key").to_pylist()
                        traces = _traces(batch.column("_trace"))
                        heads = [i for i, k in enumerate(names) if not share or k != (names[i - 1] if i else last[0])]
                        found = {i: told(traces[i], got) for i, got in zip(heads, pool.map([traces[i] for i in heads]))}
                        rows, docs = [], []
                        for i, k in enumerate(names):
                            if i in found:
                                last = (k, found[i])
                            rows += [i] * len(last[1])
                            docs += last[1]
                        carried = batch.take(pa.array(rows, pa.int64()))
                        new = [pa.array([d.get(c) for d in docs], pa.int32() if t == "int" else pa.string()) for c, t in DOC.items()]
                        yield pa.RecordBatch.from_arrays([*carried.columns, *new], names=[*batch.schema.names, *DOC])
                finally:
                    pool.close()
                    if close:
                        close()

            added = [StructField(c, IntegerType() if t == "int" else StringType()) for c, t in DOC.items()]
            return keys.mapInArrow(run, StructType([*keys.schema.fields, *added]))

        return fetch

    plain = fetcher(False)
    plain.sharing = fetcher(True)
    return plain


class PageBrowser:
    """An agent with a session over a table of pages in memory: links, frames and forms work, scripts do not run.

    Selectors are those of ``html.find_by``, in an action's entity. What a page lacks is an error, at once: nothing here takes time to appear.
    """

    def __init__(self, pages: dict[str, str]) -> None:
        self.pages = pages

    def __call__(self, trace: list[dict]) -> list[dict]:
        session = Session()
        at: list[str | None] = [None]
        frame: list[str | None] = [None]
        seen: set[str] = set()
        typed: dict[str, str] = {}

        def go(uri: str) -> None:
            if uri not in self.pages:
                raise ActionFailed(f"no page {uri}", session.backtrace)
            at[0], frame[0] = uri, None
            seen.add(uri)
            typed.clear()

        def page() -> html.Node:
            if at[0] is None:
                raise ActionFailed("no page is open", session.backtrace)
            return html.parse(self.pages[at[0]] if frame[0] is None else frame[0])

        def found(a: dict) -> html.Node:
            got = html.find_by(page(), a["entity"])
            if not got:
                raise ActionFailed(f"nothing matches {a['entity']}", session.backtrace)
            return got[0]

        def link(node: html.Node, name: str = "href") -> str:
            to = node.attr(name)
            if to is None:
                raise ActionFailed(f"<{node.tag}> leads nowhere", session.backtrace)
            return urljoin(at[0] or "", to)

        def one(a: dict) -> dict | None:
            session.did(a)
            op = a["op"]
            if op in ("visit", "get") or (op in ("click", "click_next") and a["uri"]):
                go(a["uri"])
            elif op == "click":
                go(link(found(a)))
            elif op == "click_next":  # the first link that leads to a page not seen yet
                ahead = [u for u in (link(n) for n in html.find_by(page(), a["entity"]) if n.attr("href")) if u not in seen]
                if not ahead:
                    raise ActionFailed("no next page", session.backtrace)
                go(ahead[0])
            elif op in ("wait_for", "assert"):
                found(a)
            elif op in ("text_input", "select_option"):
                where, _, value = a["entity"].rpartition("=")
                field = found(a | {"entity": where})
                if op == "select_option" and value not in [o.attr("value", False) or o.text() for o in html.find_all(field, "option")]:
                    raise ActionFailed(f"no option {value}", session.backtrace)
                typed[field.attr("name") or where] = value
            elif op == "submit":
                form = found(a)
                go(link(form, "action") + ("?" + urlencode(sorted(typed.items())) if typed else ""))
            elif op == "to_frame":
                frame[0] = self.pages[link(found(a), "src")]
            if op == "screenshot":
                return {"uri": at[0], "content": page().text(), "mime": "image/x-text", "status": 200}
            if op in EXPORTS:
                page()
                return {"uri": at[0], "content": self.pages[at[0]] if frame[0] is None else frame[0], "mime": "text/html", "status": 200}
            return None

        return run_trace(trace, one)


MockBrowser = PageBrowser
