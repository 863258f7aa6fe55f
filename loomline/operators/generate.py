"""Answers of an outside generator to prompts, each asked for once.

A prompt is known by its digest. Tasks ask for those that no published answer and
no journal entry has, a few at a time, and again after a growing pause when the
generator fails. Each answer goes to a journal file of its own, under a hidden name first,
before the next is asked for: a lost task or a broken job asks for nothing
twice that was answered. At the end all answers are published as chunks and the journal goes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.chunks import ChunkTable


def _asked(ask: Callable[[str], str], prompt: str, attempts: int, pause: float) -> str:
    for n in range(attempts):
        try:
            return ask(prompt)
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("attempts must be 1 or more")


def answer(prompts: DataFrame, table: ChunkTable, ask: Callable[[str], str], text: str = "prompt", attempts: int = 5, pause: float = 0.5, in_flight: int = 4) -> int:
    """Publish (key, answer) of the distinct prompts that ``table`` lacks; returns its version.

    ``in_flight`` prompts of a task are out at once. A prompt that fails ``attempts`` times fails the
    job, which leaves its answers in the journal for the next run. Null prompts are not asked.
    ``table.path`` is a path or URI that pyarrow opens.
    """
    key, journal = table.key, f"{table.path}/journal"

    def run(frames):
        files, folder = pafs.FileSystem.from_uri(journal) if "://" in journal else (pafs.LocalFileSystem(), journal)

        def one(digest: str, prompt: str) -> str:
            place = f"{folder}/{digest[:2]}/{digest}"
            if files.get_file_info(place).type == pafs.FileType.File:
                with files.open_input_stream(place) as stream:
                    return stream.read().decode()
            found = _asked(ask, prompt, attempts, pause)
            files.create_dir(f"{folder}/{digest[:2]}", recursive=True)
            hidden = f"{folder}/{digest[:2]}/.{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as stream:
                stream.write(found.encode())
            files.move(hidden, place)
            return found

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                yield pd.DataFrame({key: frame[key], "answer": list(pool.map(one, frame[key], frame["prompt"]))})

    rows = prompts.select(F.col(text).alias("prompt")).where("prompt is not null").distinct().withColumn(key, F.sha2("prompt", 256))
    version = table.add(rows, lambda new: new.select(key, "prompt").mapInPandas(run, f"{key} string, answer string"))
    table.remove("journal")
    return version
