"""Content-addressed identities over length-framed fields."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "0" * 32
#: Tag of a cell's published identity (fixed value).
CELL_TAG = "fel.accounting-identity/1"


def frame(c: Column) -> Column:
    """Eight bytes of length, big end first, and the text's UTF-8 bytes."""
    b = F.encode(c.cast("string"), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 16, "0")), b)


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[frame(f) for f in fields]), 256)


def derive(*fields: Column) -> Column:
    """A 128-bit identity of text fields, the first of them the tag."""
    return F.substring(digest(*fields), 1, 32)


def derive_text(*fields: str) -> str:
    """derive() of plain values, on the driver."""
    h = hashlib.sha256()
    for f in fields:
        b = f.encode()
        h.update(len(b).to_bytes(8, "big") + b)
    return h.hexdigest()[:32]


def is_id(c: Column, digits: int = 32) -> Column:
    return c.rlike(f"^[0-9a-f]{{{digits}}}$")


def accounting_identity(generation, scope, measure, category, basis, resource, flow, path, reservation) -> Column:
    """The cell's identity; subjects that are null count as nil. The period is not part of it.

    Fields are columns, or all of them names, which make one expression of text instead of a tree built call by call.
    """
    plain, subjects = (generation, scope, measure, category, basis), (resource, flow, path, reservation)
    if not all(isinstance(x, str) for x in (*plain, *subjects)):
        return digest(F.lit(CELL_TAG), *plain, *[F.coalesce(x, F.lit(NIL)) for x in subjects])
    framed = lambda x: f"unhex(lpad(hex(octet_length({x})), 16, '0')), encode({x}, 'UTF-8')"
    texts = [f"'{CELL_TAG}'", *plain, *(f"coalesce({x}, '{NIL}')" for x in subjects)]
    return F.expr(f"sha2(concat({', '.join(map(framed, texts))}), 256)")


def content_digest() -> Column:
    """Digest of an observation but its id, receive time and integrity; metadata in order.

    Fields are framed by their lengths, so no two contents give one text.
    """
    plain = ("origin", "source", "incarnation", "epoch", "sequence", "generation", "observed_at", "measure", "role", "category")
    texts = [f"cast({c} as string)" for c in plain] + [f"coalesce({c}, '-')" for c in ("resource", "flow", "path", "reservation")]
    texts += [f"cast({c} as string)" for c in ("amount", "window_start", "window_end")]
    texts.append("CASE WHEN size(metadata) > 0 THEN to_json(sort_array(metadata)) ELSE '[]' END")  # most have none, and JSON is slow
    framed = ", ".join(f"cast(length({x}) as string), ':', {x}" for x in texts)
    return F.expr(f"sha2(cast(concat('observation-content/1', {framed}) as binary), 256)")
