"""Places that every executor sees, tables written there to cut lineage, and names of columns."""

from collections.abc import Sequence

from refloom.sources.storage import materialize, new_place, remove_places, shared_dir

__all__ = ["free_names", "materialize", "new_place", "remove_places", "shared_dir"]


def free_names(names: Sequence[str], own: Sequence[str]) -> dict[str, str]:
    """Each of names to the name that it has beside the columns `own`: itself, or input_<name> (again and again) where that is taken, without regard to case."""
    taken, found = {n.lower() for n in own}, {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = f"input_{new}"
        found[name] = new
        taken.add(new.lower())
    return found
