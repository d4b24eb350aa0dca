"""Pages to audio through an engine: one engine a task, failures as rows, and runs that take up what is left."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.formats import page_file_name, variant_key
from folioflow.functions.speech import is_speakable, spoken_form
from folioflow.operators.selection import selected_rows, still_to_produce
from folioflow.operators.timeline import MOCK_RATE, SILENCE
from folioflow.sources import cache
from folioflow.sources.versions import Versions
from folioflow.store import materialize

ERROR_LENGTH = 200
# pages that a task reads at once, and bytes of samples that it holds before it hands them on
MOST_PAGES = 200
MOST_HELD = 1 << 20


@dataclass(frozen=True)
class Engine:
    """A synthesiser: ``load`` is called once in every task and gives a function from text to 16-bit mono PCM of ``rate`` samples a second."""

    name: str
    voice: str
    rate: int
    load: Callable[[], Callable[[str], bytes]]

    @property
    def variant(self) -> Column:
        return variant_key(F.lit(self.name), F.lit(self.voice))


def mock_engine(refused: str | None = None) -> Engine:
    """An engine of a hundredth of a second of silence for each character; it fails on texts that hold ``refused``."""

    def load() -> Callable[[str], bytes]:
        def speak(text: str) -> bytes:
            if refused is not None and refused in text:
                raise ValueError(f"cannot read {refused!r} in: {text}")
            return bytes(2 * (len(text) * MOCK_RATE // 100))

        return speak

    return Engine("mock", "silent", MOCK_RATE, load)


_SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_OUTCOME = pa.schema([("book_id", pa.string()), ("page_no", pa.int32()), ("state", pa.string()), ("duration_ms", pa.int64()), ("spans", _SPANS), ("synth_s", pa.float64()), ("pcm", pa.binary()), ("error", pa.string())])
OUTCOME = "book_id string, page_no int, state string, duration_ms long, spans array<struct<start_ms:long,end_ms:long>>, synth_s double, pcm binary, error string"


def _synthesised(speak: Callable[[str], bytes], rate: int, sentences: list[dict], keep: bool) -> tuple[list[bytes], int, list[dict]]:
    """Parts of a page's PCM (none unless kept), its bytes, and where each sentence lies."""
    parts, size, spans = [], 0, []
    for s in sentences:
        said = speak(s["spoken"]) if s["speakable"] else b""
        pause = 2 * int(SILENCE[s["gap"]] * rate)
        spans.append({"start_ms": round(size // 2 * 1000 / rate), "end_ms": round((size + len(said)) // 2 * 1000 / rate)})
        size += len(said) + pause
        if keep:
            parts += [said, bytes(pause)]
    return parts, size, spans


def page_audio(speak: Callable[[str], bytes], rate: int, sentences: list[dict]) -> tuple[bytes, list[dict]]:
    """PCM of a page and where each sentence (spoken, speakable, gap) lies in it; the silence after a sentence is not part of it."""
    parts, _, spans = _synthesised(speak, rate, sentences, True)
    return b"".join(parts), spans


def _page_groups(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """Rows of a batch, ``MOST_PAGES`` at a time."""
    return (batch.slice(at, MOST_PAGES).to_pylist() for at in range(0, batch.num_rows, MOST_PAGES))


def _outcomes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), _OUTCOME)], schema=_OUTCOME)


def produce(pages: DataFrame, engine: Engine, speak: Callable[[Column, Column], Column] = spoken_form, keep_pcm: bool = False) -> DataFrame:
    """Outcome of every page (book_id, page_no, text, sentences): ``OUTCOME``, state produced or failed.

    Spoken forms are native; only the synthesis runs in Python, page by page where the pages are, without a shuffle.
    A page that fails gives its error, cut to 200 characters, and the others go on. Without ``keep_pcm`` the samples are dropped.
    """

    def sentence(s: Column) -> Column:
        text = speak(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), s["gap"] == "heading")
        return F.struct(text.alias("spoken"), is_speakable(text).alias("speakable"), s["gap"].alias("gap"))

    def outcome(page: dict, voice: Callable[[str], bytes] | None) -> tuple[tuple, Callable[[str], bytes] | None]:
        began = time.perf_counter()
        try:
            voice = voice or engine.load()
            parts, size, spans = _synthesised(voice, engine.rate, page["sentences"], keep_pcm)
            return (page["book_id"], page["page_no"], "produced", round(size / 2 * 1000 / engine.rate), spans, time.perf_counter() - began, b"".join(parts) if keep_pcm else None, None), voice
        except Exception as problem:  # one page must not end the run
            return (page["book_id"], page["page_no"], "failed", None, None, None, None, str(problem)[:ERROR_LENGTH]), voice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voice = None
        for batch in batches:
            for rows in _page_groups(batch):
                made, held = [], 0
                for page in rows:
                    row, voice = outcome(page, voice)
                    made.append(row)
                    held += len(row[6] or b"")
                    if held >= MOST_HELD:
                        yield _outcomes(made)
                        made, held = [], 0
                if made:
                    yield _outcomes(made)

    ready = pages.select(F.col("book_id").cast("string").alias("book_id"), F.col("page_no").cast("int").alias("page_no"), F.transform("sentences", sentence).alias("sentences"))
    return ready.mapInArrow(run, OUTCOME)


def run_production(shelf: Versions, engine: Engine, wanted: DataFrame, speak: Callable[[Column, Column], Column] = spoken_form) -> DataFrame:
    """Produce the ``wanted`` pages (book_id, page_no) that have no audio of this engine yet, and keep it with the books.

    Returns the outcome of every wanted page that exists (book_id, page_no, state, duration_ms, error), state skipped,
    produced or failed. Audio becomes visible at the end, all of it or none, so a run that was cut
    short is repeated, and a run after failures takes the failed pages only.
    """
    asked = selected_rows(shelf.read("pages"), wanted, ["book_id", "page_no"])
    done = shelf.read("audio").where(F.col("variant") == engine.variant).select("book_id", "page_no", "duration_ms")
    left = still_to_produce(asked, done, ["book_id", "page_no"])
    made = materialize(produce(left, engine, speak).drop("pcm", "spans"))
    skipped = asked.select("book_id", "page_no").join(done, ["book_id", "page_no"]).select("book_id", "page_no", F.lit("skipped").alias("state"), "duration_ms", F.lit(None).cast("string").alias("error"))
    outcome = materialize(made.select("book_id", "page_no", "state", "duration_ms", "error").union(skipped))
    good = made.where("state = 'produced'")
    cache.add_audio(shelf, good.select("book_id", engine.variant.alias("variant"), "page_no", page_file_name(F.col("page_no"), "mp3").alias("file"), "duration_ms"))
    return outcome
