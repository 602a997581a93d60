"""The text a mail reader would show: text parts of a raw message, decoded, without markup.

Works on str (the archive's raw text). Multipart bodies are split at their boundary lines, to any depth, with missing
closing boundaries tolerated; text parts are decoded from quoted-printable or base64 in their charset; attachments of
other types are left out; HTML loses comments, scripts and tags (tags inside a line of text join, block tags part).
"""

from __future__ import annotations

import binascii
import html
import re

_FIELD = re.compile(r"[!-9;-~]+[ \t]*:|From ")
_TYPE = re.compile(r"^content-type[ \t]*:[ \t]*([^;\n]*)([^\n]*)", re.I | re.M)
_CODING = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*([^\s;]+)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([^\s\";]+)", re.I)
_FOLD = re.compile(r"\n[ \t]+")
_BASE64_LINES = re.compile(r"\s*(?:[A-Za-z0-9+/]+={0,2}[ \t]*(?:\n|$)\s*)*")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^>]*>", re.I)


def html_text(source: str) -> str:
    """`source` as shown: markup gone, entities replaced."""
    source = _HIDDEN.sub(" ", source) if "<" in source else source
    return html.unescape(_TAG.sub(" ", _INLINE.sub("", source)))


def _to_text(data: bytes, charset: str) -> str:
    for name in (charset, "utf-8", "cp1252"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def _to_bytes(body: str, charset: str) -> bytes:
    try:
        return body.encode(charset)
    except (LookupError, UnicodeEncodeError):
        return body.encode("utf-8", "surrogatepass")


def decoded(body: str, coding: str, charset: str) -> str:
    """`body` after its transfer encoding; what is not valid in it stays as it stands."""
    if coding == "quoted-printable":
        return _to_text(binascii.a2b_qp(_to_bytes(body, charset)), charset) if "=" in body else body
    if coding == "base64":
        end = _BASE64_LINES.match(body).end()
        code = "".join(body[:end].split()).rstrip("=")
        code = code[: len(code) - (len(code) % 4 == 1)]
        try:
            return _to_text(binascii.a2b_base64(code + "=" * (-len(code) % 4)), charset) + "\n" + body[end:]
        except binascii.Error:
            return body
    return body


def shown_parts(raw: str) -> list[str]:
    """Texts of the text parts of `raw`, in order; a text without header lines is one plain part."""
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    todo = [(raw, "text/plain")]  # what is left, the next one last
    while todo:
        raw, kind = todo.pop()
        head, _, body = raw.partition("\n\n")
        if raw.startswith("\n"):
            head, body = "", raw[1:]
        elif not _FIELD.match(raw):
            head, body = "", raw
        if "\n " in head or "\n\t" in head:
            head = _FOLD.sub(" ", head)
        rest = ""
        if m := _TYPE.search(head):
            kind, rest = m[1].strip().lower() or kind, m[2]
        if kind.startswith("multipart/"):
            m = _BOUNDARY.search(rest)
            mark = "--" + (m[1] or m[2]) if m else ""
            if mark and (body.startswith(mark) or "\n" + mark in body):
                todo += reversed(_between(body, mark, "message/rfc822" if kind == "multipart/digest" else "text/plain"))
                continue
            kind = "text/plain"
        m = _CODING.search(head)
        coding = m[1].lower() if m else ""
        m = _CHARSET.search(rest)
        if kind == "message/rfc822":
            # what stands for the message must get shorter, or the text would hold itself
            inner = decoded(body, coding, "utf-8")
            if len(inner) < len(raw):
                todo.append((inner.replace("\r\n", "\n"), "text/plain"))
                continue
            kind = "text/plain"
        if kind.startswith("text/") or "/" not in kind:
            text = decoded(body, coding, m[1] if m else "utf-8")
            out.append(html_text(text) if kind == "text/html" else text)
    return out


def _between(body: str, mark: str, kind: str) -> list[tuple[str, str]]:
    """The parts of a multipart body, up to the closing boundary if there is one."""
    pieces = re.split(r"^" + re.escape(mark) + r"(--)?[ \t]*$\n?", body, flags=re.M)
    out = []
    for closing, piece in zip(pieces[1::2], pieces[2::2], strict=True):
        if closing:
            break
        out.append((piece, kind))
    return out
