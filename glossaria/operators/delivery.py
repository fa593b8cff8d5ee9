"""Planning the delivery of pending words to a word book, as joins and aggregates over stored knowledge.

Words are delivered in order of their lemma.  A word that the book has is `existing`; otherwise it is
tried up to three times.  `script` tells what the remote side would answer: kind `auth` pauses the
run before the word and everything after it stays pending; `client` fails at once; otherwise
`failures` attempts fail first.  `Delivery` runs such a plan over a store, one run at a time.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions import responses
from glossaria.shared import frozen, removed

# Waits before the attempts and between words, in milliseconds.
RETRY_DELAYS = (0, 800, 2000)
WORD_GAP = 400


def listed(pages: DataFrame) -> DataFrame:
    """(word): the words of all stored pages(status, body) of the book's list; pages that aren't fine have none."""
    return pages.where(responses.classify_response(F.col("status"), F.col("body")).isin("ok", "api")).select(F.explode(responses.listed_words(F.col("body"))).alias("word"))


def known_words(entries: DataFrame, remote: DataFrame) -> DataFrame:
    """Entries that remote(word) has."""
    return entries.join(remote.select(F.lower("word").alias("its_word")), F.col("lemma") == F.col("its_word"), "left_semi")


def new_words(entries: DataFrame, remote: DataFrame) -> DataFrame:
    return entries.join(remote.select(F.lower("word").alias("its_word")), F.col("lemma") == F.col("its_word"), "left_anti")


def with_definitions(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entries with the first of dictionary(word, nth, interpret), or an empty text."""
    first = dictionary.groupBy(F.lower("word").alias("its_word")).agg(F.min_by("interpret", "nth").alias("interpret"))
    return entries.join(first, F.col("lemma") == F.col("its_word"), "left").drop("its_word").withColumn("interpret", F.coalesce("interpret", F.lit("")))


def plan(pending: DataFrame, remote: DataFrame, script: DataFrame) -> DataFrame:
    """(lemma, outcome, attempts, waited_ms) for pending(lemma), given remote(word) and script(lemma, kind, failures)."""
    book = remote.select(F.lower("word").alias("its_word")).distinct()
    rows = pending.select("lemma").join(book, F.col("lemma") == F.col("its_word"), "left").join(script.select(F.col("lemma").alias("of"), "kind", "failures"), F.col("lemma") == F.col("of"), "left")
    rows = rows.select("lemma", F.col("its_word").isNotNull().alias("known"), F.coalesce("kind", F.lit("server")).alias("kind"), F.coalesce("failures", F.lit(0)).alias("failures"))
    # the words after the first refused one are exactly the larger ones: one row, not a running maximum
    stop = rows.where((F.col("kind") == "auth") & ~F.col("known")).agg(F.min("lemma").alias("stop"))
    rows = rows.join(F.broadcast(stop), F.lit(True))
    attempts = F.when(F.col("kind") == "client", 1).otherwise(F.least(F.lit(len(RETRY_DELAYS)), F.col("failures") + 1))
    failed = (F.col("kind") == "client") | (F.col("failures") >= len(RETRY_DELAYS))
    paused = F.col("lemma") >= F.coalesce("stop", F.lit("\U0010ffff"))
    outcome = F.when(paused, "pending").when(F.col("known"), "existing").when(failed, "failed").otherwise("succeeded")
    tried = F.when(outcome.isin("pending", "existing"), 0).otherwise(attempts)
    waits = F.element_at(F.array(*(F.lit(sum(RETRY_DELAYS[:n])) for n in range(len(RETRY_DELAYS) + 1))), tried + 1)
    return rows.select("lemma", outcome.alias("outcome"), tried.cast("int").alias("attempts"), waits.cast("int").alias("waited_ms"))


def progress(planned: DataFrame) -> DataFrame:
    """(lemma, processed, succeeded, existing, failed, pending): the tallies after each word that was processed.

    Running sums in two steps, within the words of one beginning and over the beginnings, so that no task has all words.
    """
    n = {o: F.when(F.col("outcome") == o, 1).otherwise(0) for o in ("succeeded", "existing", "failed")}
    rows = planned.select("lemma", F.substring("lemma", 1, 3).alias("begins"), (F.col("outcome") != "pending").cast("int").alias("processed"), *(v.alias(k) for k, v in n.items()))
    names = ["processed", *n]
    starts = Window.orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)  # a row for each beginning, 27 ** 3 or so
    bases = rows.groupBy("begins").agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("all"))
    total = bases.agg(F.sum("all").alias("total"))
    bases = bases.select(F.col("begins").alias("its_begins"), *(F.coalesce(F.sum(c).over(starts), F.lit(0)).alias(f"{c}_before") for c in names))
    within = Window.partitionBy("begins").orderBy("lemma").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.where("processed = 1").join(bases, F.col("begins") == F.col("its_begins"))
    sums = sums.select("lemma", *((F.col(f"{c}_before") + F.sum(c).over(within)).alias(c) for c in names))
    return sums.join(F.broadcast(total), F.lit(True)).select("lemma", *names, (F.col("total") - F.col("processed")).alias("pending"))


def summary(planned: DataFrame, login: str = "ok") -> DataFrame:
    """One row of tallies; failed words count as processed.

    login is what the check before the run said: any other than ok pauses the run before anything is read.
    `error` is of the pause or else of the last word that failed.
    """
    if login != "ok":
        planned = planned.where("false")
    n = lambda o: F.count_if(F.col("outcome") == o)
    done = F.count_if(F.col("outcome") != "pending")
    phase = F.lit("paused") if login != "ok" else F.when(done < F.count("*"), "paused").otherwise("completed")
    gaps = F.greatest(F.lit(0), done - 1) * WORD_GAP
    error = F.lit(login) if login != "ok" else F.when(done < F.count("*"), "auth").otherwise(F.max_by(F.when(F.col("attempts") == 1, "client").otherwise("server"), F.when(F.col("outcome") == "failed", F.col("lemma"))))
    tallies = planned.agg(phase.alias("phase"), F.count("*").alias("total"), done.alias("processed"), n("succeeded").alias("succeeded"), n("existing").alias("existing"), n("failed").alias("failed"), n("pending").alias("pending"), gaps.alias("gap_ms"), error.alias("error"), F.count_if(F.col("outcome") == "failed").alias("n"))
    return tallies.withColumn("error", F.when((F.col("phase") == "paused") | (F.col("n") > 0), F.col("error"))).drop("n")


IDLE = {"phase": "idle", "total": 0, "processed": 0, "succeeded": 0, "existing": 0, "failed": 0, "pending": 0, "current": None, "error": None}


class Delivery:
    """Delivers a store's pending words, one run at a time.

    remote() gives the book's words, script(pending) what the remote side answers, login() the state of
    the login (see responses.login_state).  `told` gets each change of the status.
    """

    def __init__(self, store, remote: Callable[[], DataFrame], script: Callable[[DataFrame], DataFrame], login: Callable[[], str] = lambda: "ok", told: Callable[[dict], None] | None = None):
        self.store, self.remote, self.script, self.login, self.told = store, remote, script, login, told
        self._lock, self._running, self._status = threading.Lock(), None, dict(IDLE)

    def status(self) -> dict:
        return dict(self._status)

    def start(self) -> Future:
        """The run that is going on, or a new one; its result is the last status."""
        with self._lock:
            if self._running is None or self._running.done():
                self._running = Future()
                threading.Thread(target=self._finish, args=(self._running,), daemon=True).start()
            return self._running

    def _finish(self, run: Future) -> None:
        self._change(**IDLE | {"phase": "running"})
        try:
            self._run()
        except Exception as e:  # outside the words: the run pauses, whatever it was
            self._change(phase="paused", current=None, error=str(e))
        run.set_result(self.status())

    def _change(self, **fields) -> None:
        self._status = self._status | fields
        if self.told:
            self.told(self.status())

    def _run(self) -> None:
        state = self.login()
        if state != "ok":
            self._change(phase="paused", error=state)
            return
        pending = self.store.list_pending()
        planned = frozen(plan(pending, self.remote(), self.script(pending)), "delivery")
        total = planned.count()
        self._change(total=total, pending=total)
        if self.told:
            for r in progress(planned).orderBy("lemma").toLocalIterator():
                self._change(current=r["lemma"], **{k: r[k] for k in ("processed", "succeeded", "existing", "failed", "pending")})
        self.store.mark_pushed(planned.where(F.col("outcome").isin("existing", "succeeded")).select("lemma"))
        last = summary(planned).first().asDict()
        self._change(current=None, **{k: last[k] for k in IDLE if k in last})
        removed(planned)
