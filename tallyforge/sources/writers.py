"""Writes a DataFrame to one file (small results) or a folder, by suffix; and files of the driver with a fallback for locked ones."""

from __future__ import annotations

import json
import math
import shutil
import time
import warnings
import zipfile
from collections.abc import Callable
from datetime import datetime
from itertools import chain
from pathlib import Path
from uuid import uuid4
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows a sheet can hold, header included (fixed value of the format).
SHEET_ROWS = 1_048_576


def write_with_fallback(path: str | Path, write: Callable[[Path], None], max_retries: int = 2, retry_delay: float = 0.5) -> Path:
    """Tries again on PermissionError, then writes beside the file under a name with the time and warns."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    for turn in range(max_retries + 1):
        try:
            write(target)
            return target
        except PermissionError:
            if turn < max_retries:
                time.sleep(retry_delay)
    other = target.with_name(f"{target.stem}_{datetime.now():%Y%m%d_%H%M%S}{target.suffix}")
    try:
        write(other)
    except PermissionError as e:
        raise PermissionError(f"neither {target} nor {other} can be written") from e
    warnings.warn(f"{target} is locked; written to {other}", RuntimeWarning, stacklevel=2)
    return other


def plain(value):
    """Values JSON can hold: numbers stay numbers, NaN and infinities become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if isinstance(value, (str, int, bool, type(None))) else str(value)


def save_json(path: str | Path, data) -> Path:
    return write_with_fallback(path, lambda p: p.write_text(json.dumps(plain(data), indent=2, ensure_ascii=False), encoding="utf-8"))


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(path: Path, columns: list[str], rows) -> None:
    """One sheet with inline strings; rows are streamed."""
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }

    def cell(v, ref: str) -> str:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        text = "".join(ch for ch in str(v) if ch >= " " or ch in "\t\n\r")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate(chain([columns], rows), 1):
                if n > SHEET_ROWS:
                    raise ValueError(f"a sheet holds at most {SHEET_ROWS} rows; write Parquet instead")
                f.write(f'<row r="{n}">{"".join(cell(v, f"{_letters(i)}{n}") for i, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


def write_table(df: DataFrame, path: str | Path, single_file: bool = False) -> Path:
    """csv, json (one array), parquet or xlsx; any other suffix becomes .csv. Returns the path written.

    csv, json and parquet become a folder written by all executors, or with ``single_file`` one file written by one task. The new one replaces the old one
    only when it is complete, so a table can be written over the file it is read from.
    """
    target = Path(path)
    suffix = target.suffix.lower()
    if suffix not in (".csv", ".json", ".parquet", ".xlsx", ".xlsm"):
        target, suffix = target.with_suffix(".csv"), ".csv"
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid4().hex}")
    if suffix in (".xlsx", ".xlsm"):
        write_xlsx(part, df.columns, (tuple(r) for r in df.toLocalIterator()))
        return Path(shutil.move(part, target))
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if suffix == ".csv":
        out.csv(str(part), header=True, escape='"')
    elif suffix == ".parquet":
        out.parquet(str(part))
    else:
        out.json(str(part), ignoreNullFields=False)
    if target.is_dir():
        shutil.rmtree(target)
    elif target.exists() and not single_file:
        target.unlink()
    if not single_file:
        return Path(shutil.move(part, target))
    files = sorted(part.glob("part-*"))
    if suffix == ".json":
        whole = part / "whole"
        with whole.open("w", encoding="utf-8") as f:
            f.write("[")
            first = True
            for p in files:
                with p.open(encoding="utf-8") as lines:
                    for line in lines:
                        f.write(("\n  " if first else ",\n  ") + line.rstrip("\n"))
                        first = False
            f.write("\n]\n")
        shutil.move(whole, target)
    elif files:
        shutil.move(files[0], target)
    else:
        target.write_text(",".join(df.columns) + "\n")
    shutil.rmtree(part, ignore_errors=True)
    return target

