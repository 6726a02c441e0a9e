"""Builders of test inputs: equation bytes and document archives."""

import io
import zipfile

HEAD = bytes.fromhex("0501000700") + b"TEST\0\0"


def equation(*parts: bytes) -> bytes:
    return HEAD + b"".join(parts) + b"\0"


def line(*parts: bytes) -> bytes:
    return b"\1\0" + b"".join(parts) + b"\0"


def char(code) -> bytes:
    return b"\2\0\0" + (ord(code) if isinstance(code, str) else code).to_bytes(2, "little")


def template(selector: int, variation: int, *slots: bytes) -> bytes:
    return bytes([3, 0, selector, variation, 0]) + b"".join(slots) + b"\0"


def accent(code: int, *inner: bytes) -> bytes:
    return bytes([6, 0, code]) + b"".join(inner) + b"\0"


def matrix(rows: int, cols: int, *cells: bytes) -> bytes:
    return bytes([5, 0, 0, 0, 0, rows, cols, 0, 0]) + b"".join(cells) + b"\0"


NAMESPACES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:o="urn:schemas-microsoft-com:office:office"'
)


def para(text: str = "", style: str = "", extra: str = "") -> str:
    properties = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    run = f"<w:r><w:t>{text}</w:t></w:r>" if text else ""
    return f"<w:p>{properties}{run}{extra}</w:p>"


def image(rid: str) -> str:
    return f'<w:r><w:drawing><a:blip r:embed="{rid}"/></w:drawing></w:r>'


def ole(rid: str, program: str = "Equation.3") -> str:
    return f'<w:r><w:object><o:OLEObject ProgID="{program}" r:id="{rid}"/></w:object></w:r>'


def archive(body: str, images: dict | None = None, blobs: dict | None = None, footnotes: dict | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NAMESPACES}><w:body>{body}</w:body></w:document>")
        targets = {rid: f"media/{rid}.png" for rid in images or {}} | {rid: f"embeddings/{rid}.bin" for rid in blobs or {}}
        rels = "".join(f'<Relationship Id="{rid}" Target="{t}"/>' for rid, t in targets.items())
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for rid, data in (images or {}).items():
            z.writestr(f"word/media/{rid}.png", data)
        for rid, data in (blobs or {}).items():
            z.writestr(f"word/embeddings/{rid}.bin", data)
        if footnotes:
            notes = "".join(f'<w:footnote w:id="{i}"><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:footnote>' for i, t in footnotes.items())
            z.writestr("word/footnotes.xml", f"<w:footnotes {NAMESPACES}>{notes}</w:footnotes>")
    return out.getvalue()
