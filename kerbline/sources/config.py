"""Path profiles: small YAML files that say where a project's data lies."""

from __future__ import annotations

import os
from pathlib import Path
from types import MappingProxyType

VARIABLE = "KERBLINE_PROFILE"
# fixed values: the places a profile names; the first holds the others
PLACES = ("project_root", "raw_data_root", "manifests_dir", "processed_dir", "samples_dir", "outputs_dir")


class Profile:
    """Places by name, as absolute paths; ``profile.samples_dir`` and ``profile["samples_dir"]`` are the same."""

    def __init__(self, name: str, places: dict[str, Path]) -> None:
        if missing := [p for p in PLACES if p not in places]:
            raise KeyError(f"path profile {name} lacks {', '.join(missing)}")
        self.profile_name, self.places = name, MappingProxyType({p: places[p] for p in PLACES})

    def __getitem__(self, place: str) -> Path:
        return self.places[place]

    def __getattr__(self, place: str) -> Path:
        try:
            return self.__dict__["places"][place]
        except KeyError:
            raise AttributeError(place) from None

    def described(self) -> dict[str, str]:
        return {"profile_name": self.profile_name} | {p: str(at) for p, at in self.places.items()}


def load_paths(profile: str | None = None, folder: str | Path = "configs/paths") -> Profile:
    """The profile named by the argument, else by KERBLINE_PROFILE, else ``local``. Relative paths count from the
    project root, which itself counts from the folder two above the profiles."""
    import yaml

    name = profile or os.environ.get(VARIABLE) or "local"
    try:
        text = Path(folder, f"{name}.yaml").read_text(encoding="utf-8")
    except FileNotFoundError:
        raise FileNotFoundError(f"no path profile {name} in {folder}") from None
    given = yaml.safe_load(text)
    at = {PLACES[0]: Path(os.path.realpath(Path(folder).resolve().parent.parent / given["paths"].get(PLACES[0], ".")))}
    for place, path in given["paths"].items():
        at.setdefault(place, Path(os.path.realpath(at[PLACES[0]] / path)))
    return Profile(given.get("profile_name", name), at)
