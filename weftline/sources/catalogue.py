"""All source mappings by the source's name."""

from __future__ import annotations

from . import events, normalize, portals

NORMALIZERS = {**normalize.NORMALIZERS, **portals.NORMALIZERS, **events.NORMALIZERS}
