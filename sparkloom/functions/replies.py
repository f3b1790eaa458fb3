"""The JSON object in a model's reply, found by one scan; for use inside Python operators.

The native columns extract_json and repair_json work by patterns; here a stack
of open brackets tells where the object ends, what to close if the reply breaks
off, and which commas stand before a closer. Brackets in strings don't count.
"""

from __future__ import annotations

CLOSER = {"{": "}", "[": "]"}


def object_text(reply: str) -> str:
    """The first object, with open brackets and strings closed; the whole reply where there is none."""
    start = reply.find("{")
    if start < 0:
        return reply.strip()
    out: list[str] = []
    stack: list[str] = []
    quoted = escaped = False
    for c in reply[start:]:
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in CLOSER:
            stack.append(CLOSER[c])
        elif c in "}]":
            _drop_comma(out)
            while stack and stack[-1] != c:
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        out.append(c)
        if not stack:
            break
    if quoted:
        out.append('"')
    if stack:
        _drop_comma(out)
    return "".join(out + stack[::-1])


def _drop_comma(out: list[str]) -> None:
    i = len(out) - 1
    while i >= 0 and out[i].isspace():
        i -= 1
    if i >= 0 and out[i] == ",":
        del out[i]
