"""Collecting: messages in, a store and a delivery behind them.

`Collector.handle` takes a message as JSON and gives the reply, or None for a message that gets none.
A merge is acknowledged with the new counts and then may start a delivery, if the setting for it
isn't off; an explicit retry and a successful login start one whatever the setting.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions import responses
from glossaria.operators import words
from glossaria.operators.delivery import Delivery
from glossaria.sources import html, wordlist_csv
from glossaria.sources.store import VocabularyStore


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _carries(message: dict, what: str) -> bool:
    """Whether a message has what its type must carry; the same rules as responses.valid_message."""
    if what == "entries":
        entries = message.get("entries")
        return isinstance(entries, list) and all(isinstance(e, dict) and isinstance(e.get("lemma"), str) and _number(e.get("flags")) for e in entries)
    if what == "lemmas":
        return isinstance(message.get("lemmas"), list) and all(isinstance(x, str) for x in message["lemmas"])
    if what == "file":
        return isinstance(message.get("csvText"), str) and isinstance(message.get("fileName"), str)
    return True


class Collector:
    def __init__(self, store: VocabularyStore, delivery: Delivery | None = None, auto_push: Callable[[], object] = lambda: None):
        self.store, self.delivery, self.auto_push = store, delivery, auto_push

    def counts(self) -> dict:
        return self.store.counts().first().asDict()

    def start(self) -> Future | None:
        return self.delivery.start() if self.delivery else None

    def merged(self, entries: DataFrame) -> dict:
        """Merges, then starts a delivery unless the setting says no; its failure doesn't change the answer."""
        self.store.merge_collected(entries)
        counts = self.counts()
        try:
            if self.auto_push() is not False:  # a setting that isn't a boolean counts as true
                self.start()
        except Exception:  # noqa: BLE001, S110  what was merged stays merged
            pass
        return counts

    def handle(self, message: str) -> dict | None:
        try:
            m = json.loads(message)
        except ValueError:
            return None
        kind = m.get("type") if isinstance(m, dict) else None
        if kind not in responses.MESSAGES or not _carries(m, responses.MESSAGES[kind]):
            return None
        run = getattr(self, f"_{kind.lower()}", None)
        try:
            return run(m) if run else None
        except Exception:  # noqa: BLE001  the sender gets an error instead
            return {"ok": False, "error": _FAILED[kind]}

    def _entries(self, rows: list[tuple[str, int]]) -> DataFrame:
        return self.store.spark.createDataFrame(rows, words.ENTRY)

    def _words_collected(self, m: dict) -> dict:
        return self.merged(self._entries([(e["lemma"], int(e["flags"])) for e in m["entries"]]))

    def _get_counts(self, m: dict) -> dict:
        return self.counts()

    def _mark_pushed(self, m: dict) -> dict:
        self.store.mark_pushed(self.store.spark.createDataFrame([(x,) for x in m["lemmas"]], "lemma string"))
        return self.counts()

    def _retry_push(self, m: dict) -> None:
        self.start()

    def _get_push_status(self, m: dict) -> dict | None:
        return self.delivery.status() if self.delivery else None

    def _check_login(self, m: dict) -> dict:
        try:
            logged_in = self.delivery is not None and self.delivery.login() == "ok"
        except Exception:  # noqa: BLE001  whatever went wrong, it isn't a login
            logged_in = False
        if logged_in:
            self.start()
        return {"loggedIn": logged_in}

    def _export_csv(self, m: dict) -> dict:
        return {"ok": True, "csv": self.store.export_csv()}

    def _import_csv(self, m: dict) -> dict:
        rows = []
        for _, lemma, flags, _, error in wordlist_csv.parse(m["csvText"]):
            if error:
                return {"ok": False, "error": f"{m['fileName']}: {error}"}
            rows.append((lemma, flags))
        return self.merged(self._entries(rows))


# The errors of messages that could not be answered.
_FAILED = {
    "WORDS_COLLECTED": "merge-collected-failed", "GET_COUNTS": "counts-failed", "MARK_PUSHED": "mark-failed", "CHECK_LOGIN": "check-login-failed",
    "EXPORT_CSV": "export-failed", "IMPORT_CSV": "import-failed", "RETRY_PUSH": "retry-failed", "GET_PUSH_STATUS": "status-failed",
}


def run_collection(pages: DataFrame, store: VocabularyStore, extract: Callable[[DataFrame], DataFrame] = words.extract_entries, after: Callable[[], object] = lambda: None, read: Callable[[DataFrame], DataFrame] = html.collect_pages) -> dict:
    """Reads pages(html[, selection]), extracts their words, merges them and says how many there were; then calls `after`."""
    entries = extract(read(pages))
    store.merge_collected(entries)
    count = entries.select(F.lower("lemma")).distinct().count()
    after()
    return {"ok": True, "count": count}
