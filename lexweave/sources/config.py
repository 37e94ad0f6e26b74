"""Configuration files: the scoring rule, the source site and the model."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"


class ConfigError(Exception):
    """A configuration file is missing or malformed."""


def _plain_yaml(text: str) -> dict:
    """Flat ``key: value`` files, for a box without a YAML library."""
    out: dict = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        key, colon, value = line.partition(":")
        if not colon or line[:1].isspace():
            raise ValueError(f"not a flat mapping: {line!r}")
        value = value.strip()
        if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
            out[key.strip()] = value[1:-1]
        elif value.lower() in ("true", "false"):
            out[key.strip()] = value.lower() == "true"
        else:
            for kind in (int, float, str):
                try:
                    out[key.strip()] = kind(value)
                    break
                except ValueError:
                    continue
    return out


def read_mapping(path: Path, required: tuple[str, ...]) -> dict:
    """The mapping in a YAML file; each required key must be there, others are ignored."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError as error:
        raise ConfigError(f"configuration not found: {path}") from error
    try:
        import yaml

        load, broken = yaml.safe_load, yaml.YAMLError
    except ImportError:
        load, broken = _plain_yaml, ValueError
    try:
        values = load(text) or {}
    except broken as error:
        raise ConfigError(f"{path} is not valid YAML: {error}") from error
    lacking = [k for k in required if k not in values]
    if lacking:
        raise ConfigError(f"{path} lacks {', '.join(lacking)}")
    return values


def listed(path: Path, what: str) -> list[str]:
    """Lines of a text file without blanks and # comments, in order."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except FileNotFoundError as error:
        raise ConfigError(f"{what} not found: {path}") from error
    return [x for x in map(str.strip, lines) if x and not x.startswith("#")]


@dataclass(frozen=True)
class ScoringConfig:
    version: str
    ngram_size: int
    stopwords: frozenset
    casefold: bool
    strip_diacritics: bool
    reuse_threshold: float

    @classmethod
    def load(cls, path: Path = CONFIG_DIR / "scoring.yaml") -> "ScoringConfig":
        path = Path(path)
        names = ("version", "ngram_size", "casefold", "strip_diacritics", "stopwords_file", "reuse_threshold")
        raw = read_mapping(path, names)
        size = raw["ngram_size"]
        if isinstance(size, bool) or not isinstance(size, int) or size < 1:
            raise ConfigError(f"ngram_size must be a whole number from 1 on, got {size!r}")
        fold = bool(raw["casefold"])
        words = listed(path.parent / str(raw["stopwords_file"]), "stopword list")
        return cls(
            str(raw["version"]), size, frozenset(w.casefold() if fold else w for w in words), fold,
            bool(raw["strip_diacritics"]), float(raw["reuse_threshold"]),
        )


@dataclass(frozen=True)
class SourceConfig:
    name: str
    url_list: str
    user_agent: str
    request_delay_seconds: float
    timeout_seconds: float
    main_text_selector: str

    @classmethod
    def load(cls, path: Path = CONFIG_DIR / "source.yaml") -> "SourceConfig":
        names = ("name", "url_list", "user_agent", "request_delay_seconds", "timeout_seconds", "main_text_selector")
        raw = read_mapping(path, names)
        text = [str(raw[k] or "") for k in names]
        return cls(text[0], text[1], text[2], float(raw[names[3]]), float(raw[names[4]]), text[5])


@dataclass(frozen=True)
class ModelConfig:
    model: str
    max_tokens: int
    questions_per_article: int

    @classmethod
    def load(cls, path: Path = CONFIG_DIR / "model.yaml") -> "ModelConfig":
        raw = read_mapping(path, ("model", "max_tokens", "questions_per_article"))
        return cls(str(raw["model"]), int(raw["max_tokens"]), int(raw["questions_per_article"]))


def read_url_list(path: Path) -> list[str]:
    """URLs in order, duplicates kept; none at all is an error."""
    urls = listed(path, "URL list")
    if not urls:
        raise ConfigError(f"no URL in {path}")
    return urls
