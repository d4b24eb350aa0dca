"""Audio timeline of sentences through a pluggable synthesiser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.speech import is_speakable, spoken_form

# fixed values: silence after a sentence, in seconds
SILENCE = {"sentence": 0.25, "paragraph": 0.6, "heading": 0.9}
MOCK_RATE = 8000


def mock_samples(spoken: Column) -> Column:
    """Speech length of the mock engine: a hundredth of a second for each character."""
    return F.floor(F.length(spoken) * MOCK_RATE / 100).cast("long")


def engine_samples(engine: Callable[[], Callable[[str], bytes]]):
    """Arrow UDF spoken text -> struct(samples, error) over a synthesiser of 16-bit mono PCM.

    ``engine`` is called once in each worker. A text that fails gives its error, cut to 200
    characters, and the others go on.
    """

    @F.pandas_udf("samples long, error string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        speak = engine()
        for batch in texts:
            rows = []
            for text in batch:
                try:
                    rows.append((len(speak(text)) // 2 if text is not None else None, None))
                except Exception as problem:  # one text must not end the run
                    rows.append((None, str(problem)[:200]))
            yield pd.DataFrame(rows, columns=["samples", "error"])

    return run


def timeline(sentences: DataFrame, samples: Callable[[Column], Column] = mock_samples, rate: int = MOCK_RATE, speak: Callable[[Column, Column], Column] = spoken_form) -> DataFrame:
    """``sentences`` (book_id, page_no, sent_no, sentence, gap) with spoken, start_ms and end_ms within the page.

    A sentence starts where all speech and silence before it ends; text with nothing to
    speak is silence only. Milliseconds round half to even.
    """
    spoken = sentences.withColumn("spoken", speak(F.col("sentence"), F.col("gap") == "heading"))
    speech = F.when(is_speakable(F.col("spoken")), samples(F.col("spoken"))).otherwise(0).cast("long")
    sized = spoken.withColumn("__speech", speech).withColumn("__silence", silence(rate))
    page = Window.partitionBy("book_id", "page_no").orderBy("sent_no")
    sized = sized.withColumn("__start", F.coalesce(F.sum(F.col("__speech") + F.col("__silence")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sized.withColumn("start_ms", milliseconds(F.col("__start"), rate)).withColumn("end_ms", milliseconds(F.col("__start") + F.col("__speech"), rate)).withColumn("samples", F.col("__speech") + F.col("__silence")).drop("__speech", "__silence", "__start")


def silence(rate: int) -> Column:
    kinds = F.create_map(*[F.lit(x) for kind, seconds in SILENCE.items() for x in (kind, int(seconds * rate))])
    return F.element_at(kinds, F.col("gap")).cast("long")


def milliseconds(samples: Column, rate: int) -> Column:
    return F.bround(samples * 1000 / rate, 0).cast("long")


def page_durations(timed: DataFrame, rate: int = MOCK_RATE) -> DataFrame:
    """(book_id, page_no, duration_ms): all samples of a page, closing silence included."""
    return timed.groupBy("book_id", "page_no").agg(milliseconds(F.sum("samples"), rate).alias("duration_ms"))
