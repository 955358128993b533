"""Named column lists; a model only ever sees one of these, never a metadata column."""

from __future__ import annotations

from .fixed import ALL_TRIVIAL, BEHAVIOUR_SETS, SHORTCUT_COLUMNS

ALL_BEHAVIOUR = BEHAVIOUR_SETS["with_global"]

#: what an audit of trivial cues fits on: each group alone, and all of them
SHORTCUT_SETS: dict[str, list[str]] = {**SHORTCUT_COLUMNS, "all_trivial": ALL_TRIVIAL}
