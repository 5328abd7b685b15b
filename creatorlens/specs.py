"""Parameters of a segment analysis: who is compared with whom, on which bins."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fv

TIER_NAMES = ("Micro", "Small", "Mid", "Large", "Mega")


def short_number(n: float) -> str:
    """1000 -> '1K', 2500000 -> '2.5M'."""
    for size, unit in ((1_000_000, "M"), (1_000, "K")):
        if n >= size:
            scaled = n / size
            return f"{scaled:.0f}{unit}" if scaled == int(scaled) else f"{scaled:g}{unit}"
    return f"{n:g}"


def range_labels(edges, suffix: str = "", dash: str = "-") -> list[str]:
    """Text of each interval cut by ``edges``: '<1K', '1K-10K', ..., '500K+'."""
    e = [short_number(x) for x in edges]
    inner = [f"{a}{dash}{b}{suffix}" for a, b in zip(e, e[1:])]
    return [f"<{e[0]}{suffix}", *inner, f"{e[-1]}+{suffix}"]


@dataclass(frozen=True)
class SegmentSpec:
    """Roles and bins used by the reports, gap and validation jobs."""

    benchmark: str = fv.GIANTS
    target: str = fv.SPECIALISTS
    # column suffix in the cross-tab -> archetype label
    crosstab: tuple[tuple[str, str], ...] = (
        ("giants", fv.GIANTS),
        ("niche", fv.SPECIALISTS),
        ("viral", fv.VIRAL),
        ("volume", fv.VOLUME),
        ("dabblers", fv.DABBLERS),
    )
    tier_edges: tuple[int, ...] = fv.TIER_EDGES
    sub_tier_edges: tuple[int, ...] = fv.SUB_TIER_EDGES
    cadence_edges: tuple[int, ...] = fv.CADENCE_EDGES
    cadence_labels: tuple[str, ...] = fv.CADENCE_LABELS  # lowest interval first
    video_retention_edges: tuple[int, ...] = fv.VIDEO_RETENTION_EDGES
    video_retention_labels: tuple[str, ...] = fv.VIDEO_RETENTION_LABELS

    # -- labels, lowest interval first --
    def tier_labels(self) -> list[str]:
        """'Micro (<1K)' ... 'Mega (500K+)': the stored column's labels."""
        return [f"{n} ({r})" for n, r in zip(TIER_NAMES, range_labels(self.tier_edges))]

    def ranked_tier_labels(self) -> list[str]:
        """'5. Micro (<1K)' ... '1. Mega (500K+)': sortable report labels."""
        top = len(TIER_NAMES)
        return [
            f"{top - i}. {n} ({r})"
            for i, (n, r) in enumerate(zip(TIER_NAMES, range_labels(self.tier_edges, dash="–")))
        ]

    def sub_tier_labels(self) -> list[str]:
        e = [short_number(x) for x in self.sub_tier_edges]
        texts = [f"Under {e[0]}", *[f"{a}–{b}" for a, b in zip(e, e[1:])], f"{e[-1]}+"]
        return [f"{c}. {t}" for c, t in zip("ABCDE", texts)]

    @property
    def mid_range(self) -> tuple[int, int]:
        return self.tier_edges[1], self.tier_edges[2]

    def mid_label(self) -> str:
        a, b = (short_number(x) for x in self.mid_range)
        return f"Mid tier ({a}–{b})"


DEFAULT_SPEC = SegmentSpec()
