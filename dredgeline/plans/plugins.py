"""Hooks a job can install. Each is a function over frames or columns, never over single rows.

A hook that raises, or returns something the job cannot go on with, is left out for that job: the default
takes its place and ``failures`` tells which hook and why. What a hook returns is checked when the job is
put together, by its columns; a column expression of it that fails on the data fails the job like any other.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dredgeline.functions.clients import CLIENTS
from dredgeline.functions.validators import register_validator
from dredgeline.operators import filters, policy

Detector = Callable[[DataFrame], DataFrame]
X = TypeVar("X")
FINDING_COLUMNS = ("detector", "type", "severity", "action", "location", "value", "value_preview", "rule_no", "match_no")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class HookFailure:
    hook: str
    error: str


@dataclass
class Plugins:
    detectors: list[Detector] = field(default_factory=list)
    #: (findings, default) -> decided requests
    evaluate: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] | None = None
    #: (texts, findings, default) -> texts with the same columns
    redact: Callable[[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]], DataFrame] | None = None
    #: called with the results of a job
    post_scan: list[Callable[[DataFrame], Any]] = field(default_factory=list)
    #: (texts) -> texts, before responses are scanned: rows may go, texts may change
    response_filter: Callable[[DataFrame], DataFrame] | None = None
    #: (pieces) -> pieces, on every piece of a streamed response that is passed on
    response_chunk: Callable[[DataFrame], DataFrame] | None = None
    allowlist: Callable[[DataFrame], DataFrame] | None = None
    #: (calls) -> a column: 'block', 'alert' or null for each call
    tool_policy: Callable[[DataFrame], Column] | None = None
    escalation: Callable[[DataFrame], DataFrame] | None = None
    extra_clients: list[tuple] = field(default_factory=list)
    skip_rules: set[str] = field(default_factory=set)
    #: channel type -> (alerts of the channels of that type)
    channel_types: dict[str, Callable[[DataFrame], Any]] = field(default_factory=dict)
    failures: list[HookFailure] = field(default_factory=list)

    def add_detector(self, fn: Detector, first: bool = False) -> None:
        self.detectors.insert(0, fn) if first else self.detectors.append(fn)

    def add_validator(self, name: str, fn: Callable[[Column], Column]) -> None:
        register_validator(name, fn)

    def set_skip_rules(self, names: Iterable[str]) -> None:
        self.skip_rules = set(names)

    def register_clients(self, clients: Iterable[tuple]) -> None:
        """More clients: (id, display name, category, provider, prefixes of the user agent)."""
        self.extra_clients.extend(clients)

    def clients(self) -> list[tuple]:
        """The registry with the extra clients behind the built-in ones: of two that match the first counts."""
        return [*CLIENTS, *self.extra_clients]

    # ---- calling hooks ------------------------------------------------------------------------
    def _report(self, hook: str, error: object) -> None:
        self.failures.append(HookFailure(hook, str(error).split("\n", 1)[0]))
        log.warning("hook %s left out: %s", hook, error)

    def _guarded(self, hook: str, call: Callable[[], X], default: Callable[[], X], check: Callable[[X], None]) -> X:
        try:
            out = call()
            check(out)
        except Exception as exc:  # a broken hook must not stop the job; it is reported
            self._report(hook, exc)
            return default()
        return out

    @staticmethod
    def _frame_with(columns: Sequence[str] = ()) -> Callable[[DataFrame], None]:
        def check(out: DataFrame) -> None:
            if not isinstance(out, DataFrame):
                raise TypeError(f"a {type(out).__name__} in place of a DataFrame")
            missing = set(columns) - set(out.columns)
            if missing:
                raise ValueError(f"columns {sorted(missing)} are missing")

        return check

    def run_detectors(self, fields: DataFrame, findings: DataFrame) -> DataFrame:
        """Add the findings of extra detectors; each must return the finding columns."""
        out = findings
        for det in self.detectors:
            extra = det(fields)
            missing = set(FINDING_COLUMNS) - set(extra.columns)
            if missing:
                raise ValueError(f"detector {getattr(det, '__name__', det)} lacks columns {sorted(missing)}")
            out = out.unionByName(extra.select(*out.columns))
        return out

    def run_evaluate(self, findings: DataFrame, default: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The evaluate hook, or the default policy."""
        if self.evaluate is None:
            return default(findings)
        return self._guarded("evaluate", lambda: self.evaluate(findings, default), lambda: default(findings), self._frame_with())

    def run_redact(self, texts: DataFrame, findings: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
        """The redaction hook in place of ``[REDACTED:type]``; the same rows and columns come back."""

        def default(t: DataFrame, f: DataFrame) -> DataFrame:
            return policy.redact(t, f, keys, text)

        if self.redact is None:
            return default(texts, findings)
        return self._guarded("redact", lambda: self.redact(texts, findings, default), lambda: default(texts, findings), self._frame_with(texts.columns)).select(*texts.columns)

    def run_post_scan(self, results: DataFrame) -> DataFrame:
        """Hand the results to every hook, in order; they go on unchanged."""
        for fn in self.post_scan:
            self._guarded("post_scan", lambda fn=fn: fn(results), lambda: None, lambda _: None)
        return results

    def run_response_filter(self, texts: DataFrame) -> DataFrame:
        if self.response_filter is None:
            return texts
        return self._guarded("response_filter", lambda: self.response_filter(texts), lambda: texts, self._frame_with(texts.columns)).select(*texts.columns)

    def run_response_chunk(self, pieces: DataFrame) -> DataFrame:
        if self.response_chunk is None:
            return pieces
        return self._guarded("response_chunk", lambda: self.response_chunk(pieces), lambda: pieces, self._frame_with(pieces.columns)).select(*pieces.columns)

    def run_tool_policy(self, calls: DataFrame) -> Column | None:
        """The evaluator's column for ``calls``; None, which decides nothing, without one or if it fails."""
        if self.tool_policy is None:
            return None

        def check(column: Column) -> None:
            if not isinstance(column, Column):
                raise TypeError(f"a {type(column).__name__} in place of a Column")
            calls.select(column.cast("string")).schema  # names and types resolve

        return self._guarded("tool_policy", lambda: self.tool_policy(calls), lambda: None, check)

    def run_allowlist(self, findings: DataFrame, secrets: Iterable[str], pii: Iterable[str]) -> DataFrame:
        def default() -> DataFrame:
            return filters.drop_allowed_values(findings, secrets, pii)

        return self._guarded("allowlist", lambda: self.allowlist(findings), default, self._frame_with(findings.columns)) if self.allowlist else default()

    def run_channels(self, alerts: DataFrame, channel_type: str = "channel_type") -> list[str]:
        """Hand routed alerts to the senders of their channels' types; the types that were served.

        A type without a sender is reported like a failed hook, and its alerts wait for the next run.
        """
        served = []
        for name, send in self.channel_types.items():
            self._guarded(f"channel {name}", lambda name=name, send=send: (send(alerts.where(F.col(channel_type) == name)), served.append(name)), lambda: None, lambda _: None)
        known = list(self.channel_types) or [""]
        for r in alerts.where(~F.col(channel_type).isin(known)).select(channel_type).distinct().limit(100).collect():
            self._report(f"channel {r[0]}", "no sender for this type")
        return served
