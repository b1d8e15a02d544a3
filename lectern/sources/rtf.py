"""RTF to text as a byte state machine (SC3, SC4); refuses what cannot be read out faithfully."""

from __future__ import annotations

import codecs
import re

from lectern.errors import LecternError

# Character set control words and their encodings; cp1252 without any.
CHARSETS = {"mac": "mac_roman", "pc": "cp437", "pca": "cp850"}
DEFAULT = "cp1252"
# Control words that stand for text.
SYMBOLS = {
    "par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "row": "\n", "cell": "\t", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’",
    "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " ",
}
# Groups that hold no body text.
SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "headerf", "footerl", "footerr", "footerf", "generator", "listtable", "listoverridetable", "rsidtbl", "themedata", "xmlnstbl", "object", "fldinst"}
REFUSED = {"bin", "v", "deleted"}

_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def encoding_of(data: bytes) -> str:
    """SC4: the explicit code page, else the character set, else cp1252."""
    page = re.search(rb"\\ansicpg(\d+)", data[:4096])
    if page:
        name = f"cp{page[1].decode()}"
        try:
            codecs.lookup(name)
        except LookupError as e:
            raise LecternError(f"RTF code page {page[1].decode()} is unknown") from e
        return name
    kind = re.search(rb"\\(mac|pca|pc)(?![a-z])", data[:256])
    return CHARSETS[kind[1].decode()] if kind else DEFAULT


def read_rtf(data: bytes) -> str:
    """SC3: the visible text."""
    if not data.startswith(b"{\\rtf"):
        raise LecternError("not an RTF document")
    encoding = encoding_of(data)
    out: list[str] = []
    raw = bytearray()
    stack: list[tuple[bool, int]] = []
    skip, fallback, pending, at, ended = False, 1, 0, 0, False

    def flush() -> None:
        if raw:
            out.append(bytes(raw).decode(encoding, "replace"))
            raw.clear()

    while at < len(data):
        if ended:
            if data[at:].strip(b"\0\r\n \t"):
                raise LecternError("RTF goes on after its end")
            break
        m = _TOKEN.match(data, at)
        if not m:
            raise LecternError("RTF has a broken control")
        at = m.end()
        word, number, code, symbol, brace, text = m.groups()
        if brace == b"{":
            flush()
            stack.append((skip, fallback))
        elif brace == b"}":
            flush()
            if not stack:
                raise LecternError("RTF groups do not balance")
            skip, fallback = stack.pop()
            ended = not stack
        elif word:
            name = word.decode()
            value = int(number) if number else None
            if name in REFUSED and value != 0:
                raise LecternError(f"RTF has hidden, deleted or binary content ({name})")
            flush()
            if name in SKIPPED:
                skip = True
            elif name == "uc":
                fallback = value or 0
            elif name == "u" and value is not None:
                if not skip:
                    out.append(chr(value % 65536))
                pending = fallback
            elif name in SYMBOLS and not skip:
                out.append(SYMBOLS[name])
        elif symbol == b"*":
            skip = True
        elif pending and code:
            pending -= 1
        elif skip:
            continue
        elif code:
            raw.append(int(code, 16))
        elif symbol:
            if symbol in b"\\{}":
                raw += symbol
            else:
                flush()
                out.append({b"~": " ", b"_": "-", b"-": "", b"\n": "\n", b"\r": "\n"}.get(symbol, ""))
        elif text:
            cut = min(pending, len(text))
            pending -= cut
            raw += text[cut:]
    if stack or not ended:
        raise LecternError("RTF groups do not balance")
    # Surrogate pairs come as two numbers.
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").strip("\n")
