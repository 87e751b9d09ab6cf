"""What a model was sent, built up once along a session.

The hash of a request covers the JSON of all its messages.  Written out anew for each
call, a session of n calls costs n times its length.  Here a message is rendered once,
and a request is a place to go on from: it holds the running hash of its text so far,
so a further message hashes only itself, and any number of branches may go on from one
request.  Volatile spans can be masked message by message, because no rule matches
across the brackets and quotes between two messages.
"""

from __future__ import annotations

import hashlib
import json

from ..functions.hashing import HASH_LENGTH, SIMILARITY_SPEC, canonical_json, mask_text, simhash


def rendered(value: object) -> str:
    """Canonical JSON of a value as it is hashed, volatile spans masked."""
    return mask_text(canonical_json(json.dumps(value)))[0]


def short(text: str) -> str:
    """The hash of a rendered value."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:HASH_LENGTH]


class Part:
    """A message of a request: its text, who speaks, and whether some of it is withheld."""

    __slots__ = ("role", "text", "withheld")

    def __init__(self, text: str, role: object = None, withheld: bool = False):
        self.text, self.role, self.withheld = text, role, withheld


class Request:
    """The messages up to some place, by the running hash of their JSON list."""

    __slots__ = ("_above", "_last", "_state", "withheld")

    def __init__(self, above: Request | None = None, last: Part | None = None):
        self._above, self._last = above, last
        if above is None:
            self._state, self.withheld = hashlib.sha256(b"["), False
        else:
            self._state, self.withheld = above._state.copy(), above.withheld or last.withheld
            self.write("," if above._last else "", last.text)

    def then(self, *parts: Part) -> Request:
        out = self
        for part in parts:
            out = Request(out, part)
        return out

    def write(self, *texts: str) -> None:
        for text in texts:
            self._state.update(text.encode("utf-8", "surrogatepass"))

    def opened(self, text: str) -> Request:
        """A copy to write on, with the beginning of one more message."""
        out = Request()
        out._above, out._last, out._state, out.withheld = self._above, self._last, self._state.copy(), self.withheld
        out.write("," if self._last else "", text)
        return out

    def hash(self, end: str = "") -> str:
        state = self._state.copy()
        state.update(f"{end}]".encode("utf-8", "surrogatepass"))
        return state.hexdigest()[:HASH_LENGTH]

    def since_reply(self) -> list[str]:
        """Messages after the last one of the assistant, but for the system's."""
        out, at = [], self
        while at._last is not None and at._last.role != "assistant":
            if at._last.role != "system":
                out.append(at._last.text)
            at = at._above
        return out[::-1]


def likeness_marks(texts: list[str]) -> dict:
    """The similarity fingerprint of a list of rendered values."""
    return {"similarity_fingerprint": f"{simhash('[' + ','.join(texts) + ']'):016x}", "similarity_spec": SIMILARITY_SPEC}
