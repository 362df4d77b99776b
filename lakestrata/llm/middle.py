"""Fill-in-the-middle texts: cut at unit borders into prefix, middle and suffix, and put in another order.

One full match of ``(unit)*`` by the regex library keeps every repetition of its group, so the ends of that group are
all borders at once: their number is ``n``, and two of them are the cuts. The cuts, whether a document is
transformed and its form follow from a hash of its id alone, so that reruns and retries agree.

Forms are ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part
after its mark. A text that holds a mark stays plain, and no mark can arise where a part meets one, so a text can be
rebuilt from output and form. Nulls are treated as empty texts, which are plain with no units. A text that units do not
cover stays plain with a null ``n``. A null id is hashed as an empty one; rows that repeat an id are cut by the same
numbers, each on its own text. Texts are never cut off: a task holds about 130 bytes for each unit of one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.frames import inputs, slices, small_batches

LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
BATCH_BYTES = 2 << 20


@lru_cache(maxsize=8)
def repeated(unit: str) -> regex.Pattern:
    if regex.fullmatch(unit, ""):
        raise ValueError("a unit must not match the empty text")
    return regex.compile(f"({unit})*")


def borders(text: str, unit: str = LINE) -> list[int] | None:
    """Where each unit of the text ends; None where units do not cover it."""
    match = repeated(unit).fullmatch(text)
    return None if match is None else match.ends(1)


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks are told apart in any output if none is empty or overlaps the end of another, or of itself."""
    for (i, a), (j, b) in product(enumerate(marks), repeat=2):
        if not a or (i != j and a in b) or any(b.startswith(a[-k:]) for k in range(1, len(a))):
            raise ValueError(f"marks {marks} overlap")


def numbers(id: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(
    id: object, text: str, unit: str, seed: int, rate: int, spm_rate: int, marks: tuple[str, str, str]
) -> tuple[int | None, str, int | None, int | None, str]:
    """``n``, form, characters of prefix and middle, and output of one text."""
    ends = borders(text, unit)
    one, two, chosen, kind = numbers(id, seed)
    if not ends or chosen % 100 >= rate or any(mark in text for mark in marks):
        return None if ends is None else len(ends), PLAIN, None, None, text
    cuts = [0, *ends]
    low, high = (cuts[i] for i in sorted((one % len(cuts), two % len(cuts))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = marks
    if kind % 100 < spm_rate:
        return len(ends), SPM, low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(ends), PSM, low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = LINE,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Per row its id, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``output``.

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of these get the form ``spm``.
    """
    check_marks(marks)
    repeated(unit)
    small_batches(df.sparkSession)
    rows = inputs(df, id=id, text=text)
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            found = [
                arrange(i, t or "", unit, seed, rate, spm_rate, marks)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *kinds])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def restored(output: Column | str = "output", form: Column | str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made of; null for a null output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)  # what comes before the first mark is empty
    psm, spm = (F.concat(*[parts.getItem(i) for i in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == PLAIN, output).when(form == PSM, psm).when(form == SPM, spm)
