"""How strict readers are and how much they may decode."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """Bounds that hold in either mode."""

    max_depth: int = 64
    max_composite_pixels: int = 1 << 24
    max_decoded_pixels: int = 1 << 24
    max_decoded_node_bytes: int = 1 << 26
    max_archive_members: int = 65_536
    max_decoded_member_bytes: int = 1 << 28


@dataclass(frozen=True)
class Options:
    """``strict`` raises at the first anomaly; lenient reading repairs it and reports a warning row."""

    strict: bool = True
    limits: Limits = field(default_factory=Limits)


class FormatError(ValueError):
    """Bytes that do not follow the format; ``code`` is a stable name of what is wrong."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class Report:
    """Collects warnings in lenient reading and raises in strict reading."""

    def __init__(self, options: Options):
        self.options = options
        self.warnings: list[str] = []

    def __call__(self, code: str, detail: str = "") -> None:
        if self.options.strict:
            raise FormatError(code, detail)
        self.warnings.append(f"{code}: {detail}" if detail else code)
