"""A small PDF writer: monospaced text pages. Characters outside Latin-1 become ``?``."""

from __future__ import annotations

from pathlib import Path

LINES, SIZE, MARGIN, WIDTH = 68, 9, 40, 95


def _wrapped(line: str) -> list[str]:
    """A line in pieces of at most WIDTH characters; what goes on is indented."""
    if len(line) <= WIDTH:
        return [line]
    rest = line[WIDTH:]
    return [line[:WIDTH], *("    " + rest[i : i + WIDTH - 4] for i in range(0, len(rest), WIDTH - 4))]


def write_pdf(path: Path, lines: list[str]) -> None:
    lines = [piece for line in lines for piece in _wrapped(line)]
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[""]]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"]
    kids = []
    for page in pages:
        shown = "".join(f"({line.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj T*\n" for line in page)
        stream = f"BT /F1 {SIZE} Tf {SIZE + 2} TL {MARGIN} {842 - MARGIN} Td\n{shown}ET".encode("latin-1", "replace")
        objects.append(b"<</Length %d>>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer <</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    path.write_bytes(bytes(out))
