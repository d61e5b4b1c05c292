"""Review under a lease, as a stream of commands and as a replay of a finished log.

Both fold the same :func:`step` over an item's commands in order of time and event id. The stream keeps an
item's commands until the watermark has passed them, so late arrivals within the allowed time take
their place; timers decide them, and end leases that nobody renewed. Commands behind the watermark
are told as late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["job_id", "item_id"]
#: A command: claim, renew, release or submit. ``expected_revision`` and ``still_open`` belong to submissions: what
#: revision the reviewer saw, and whether the result needs more review afterwards.
COMMAND = "event_id string, command string, reviewer_id string, lease_token string, at timestamp, ttl_s double, expected_revision long, still_open boolean"
AUDIT = "event_id string, action string, reviewer_id string, at timestamp, lease_revision long, result_revision long, reason string"
_STATE = "reviewer_id string, lease_token string, lease_revision long, expires_us long, ended boolean, result_revision long, open boolean"
_FIRST = {"reviewer_id": None, "lease_token": None, "lease_revision": 0, "expires_us": 0, "ended": True, "result_revision": 1, "open": True}


def _audit(state: dict, event: str, action: str, reviewer: str | None, at_us: int, reason: str | None = None) -> dict:
    return {"event_id": event, "action": action, "reviewer_id": reviewer, "at": pd.Timestamp(at_us, unit="us"), "lease_revision": state["lease_revision"], "result_revision": state["result_revision"], "reason": reason}


def expired(state: dict, upto_us: int) -> Iterator[dict]:
    """The end of a live lease by time, told once. The lease stays, so the next claim takes it over."""
    if state["reviewer_id"] is not None and not state["ended"] and state["expires_us"] <= upto_us:
        state["ended"] = True
        yield _audit(state, f"expired:{state['lease_token']}:{state['lease_revision']}", "expired", state["reviewer_id"], state["expires_us"])


def _problem(state: dict, c: dict) -> str | None:
    """Why a command of a lease's owner cannot be done."""
    if state["reviewer_id"] is None:
        return "no_lease"
    if state["reviewer_id"] != c["reviewer_id"]:
        return "other_reviewer"
    if state["lease_token"] != c["lease_token"]:
        return "other_token"
    return "lease_expired" if state["expires_us"] <= c["at_us"] else None


def step(state: dict, c: dict) -> Iterator[dict]:
    """Apply one command and tell what came of it; a refused one changes nothing."""
    yield from expired(state, c["at_us"])
    tell = lambda action, reason=None: _audit(state, c["event_id"], action, c["reviewer_id"], c["at_us"], reason)
    ttl = c["ttl_s"] if c["ttl_s"] is not None and c["ttl_s"] == c["ttl_s"] else 0.0
    until = c["at_us"] + int(ttl * 1_000_000)
    kind, live = c["command"], state["reviewer_id"] is not None and state["expires_us"] > c["at_us"]
    if kind == "claim":
        if not state["open"] or ttl <= 0:
            yield tell("refused", "ttl" if state["open"] else "not_open")
        elif live:
            mine = state["reviewer_id"] == c["reviewer_id"]
            yield tell("already_held") if mine else tell("refused", "claimed_by_other")
        else:
            action = "claimed" if state["reviewer_id"] is None else "taken_over"
            state.update(reviewer_id=c["reviewer_id"], lease_token=c["lease_token"], lease_revision=state["lease_revision"] + 1, expires_us=until, ended=False)
            yield tell(action)
        return
    reason = _problem(state, c) or ("ttl" if kind == "renew" and ttl <= 0 else None)
    if kind == "submit" and reason is None:
        reason = "not_open" if not state["open"] else "revision_conflict" if c["expected_revision"] != state["result_revision"] else None
    if kind not in ("renew", "release", "submit"):
        reason = "unknown_command"
    if reason is not None:
        yield tell("refused", reason)
    elif kind == "renew":
        state.update(lease_revision=state["lease_revision"] + 1, expires_us=until)
        yield tell("renewed")
    else:
        if kind == "submit":
            state["result_revision"] += 1
            yield tell("submitted")
        if kind == "release" or not c["still_open"]:
            if kind == "submit":
                state["open"] = False
            yield tell("released" if kind == "release" else "completed")
            state.update(reviewer_id=None, lease_token=None, lease_revision=0, expires_us=0, ended=True)


def _command(row: Any) -> dict:
    c = row._asdict()
    whole = c["expected_revision"]
    return c | {"at_us": pd.Timestamp(c["at"]).value // 1000, "expected_revision": None if pd.isna(whole) else int(whole), "still_open": None if pd.isna(c["still_open"]) else bool(c["still_open"])}


def _frame(rows: list[dict], key: tuple) -> pd.DataFrame:
    return pd.DataFrame([{"job_id": key[0], "item_id": key[1], **r} for r in rows], columns=[*KEY, *(x.split()[0] for x in AUDIT.split(", "))])


def replay(commands: DataFrame, upto: str | None = None) -> DataFrame:
    """The audit of a finished log: of repeated events one counts; with ``upto`` (a timestamp) the log ends
    there, and leases that end by then are told. One item's log is folded in one task."""
    limit = None if upto is None else pd.Timestamp(upto).value // 1_000_000  # milliseconds, as watermarks have

    def fold(key: tuple, log: pd.DataFrame) -> pd.DataFrame:
        found = sorted({c["event_id"]: c for c in map(_command, log.drop(columns=KEY).itertuples(index=False))}.values(), key=lambda c: (c["at_us"], c["event_id"]))
        state, rows = dict(_FIRST), []
        for c in found:
            if limit is None or c["at_us"] // 1000 <= limit:
                rows += step(state, c)
        if limit is not None:
            rows += expired(state, limit * 1000 + 999)
        return _frame(rows, key)

    names = [x.split()[0] for x in COMMAND.split(", ")]
    return commands.select(*KEY, *names).groupBy(*KEY).applyInPandas(fold, f"job_id string, item_id string, {AUDIT}")


class LeaseProcessor(StatefulProcessor):
    """State of one item: its lease and result revision, and commands that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _STATE)
        self.waiting = handle.getMapState("waiting", "at_us long, event_id string", COMMAND.replace("event_id string, ", "").replace("at timestamp, ", ""))

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        state = self._state()
        for frame in rows:
            for c in map(_command, frame.drop(columns=KEY).itertuples(index=False)):
                if c["at_us"] // 1000 <= passed:
                    late.append(_audit(state, c["event_id"], "late", c["reviewer_id"], c["at_us"]))
                else:
                    self.waiting.updateValue((c["at_us"], c["event_id"]), (c["command"], c["reviewer_id"], c["lease_token"], float(c["ttl_s"]) if c["ttl_s"] == c["ttl_s"] else None, c["expected_revision"], c["still_open"]))
                    self.handle.registerTimer(c["at_us"] // 1000)
        yield _frame(late, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, passed = expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999, timerValues.getCurrentWatermarkInMs() * 1000 + 999
        state, rows, later = self._state(), [], passed
        names = ("command", "reviewer_id", "lease_token", "ttl_s", "expected_revision", "still_open")
        for (at_us, event), value in sorted(self.waiting.iterator(), key=lambda x: tuple(x[0])):
            if at_us > upto:
                later = min(later, at_us - 1)
                break
            rows += step(state, dict(zip(names, value)) | {"at_us": at_us, "event_id": event})
            self.waiting.removeKey((at_us, event))
        rows += expired(state, later)
        if state["reviewer_id"] is not None and not state["ended"]:
            self.handle.registerTimer(-(-state["expires_us"] // 1000))
        self.now.update(tuple(state.values()))
        yield _frame(rows, key)

    def _state(self) -> dict:
        return dict(zip(_FIRST, self.now.get())) if self.now.exists() else dict(_FIRST)

    def close(self) -> None:
        pass


def lease_stream(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The audit of a stream of commands, each told once the watermark has passed it. The session must use a
    state store that keeps composite state (RocksDB)."""
    names = [x.split()[0] for x in COMMAND.split(", ")]
    keyed = commands.select(*KEY, *names).withWatermark("at", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(LeaseProcessor(), f"job_id string, item_id string, {AUDIT}", "append", "EventTime")
