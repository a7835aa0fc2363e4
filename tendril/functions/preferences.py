"""What a session prefers: plain settings that become plan literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Preferences:
    excluded_platforms: list[str] = field(default_factory=list)
    disabled_sources: list[str] = field(default_factory=list)
    component_links: bool = False
    component_pricing: bool = False
    rules: list[str] = field(default_factory=list)

    def merge(self, patch: dict) -> Preferences:
        """A copy with a patch's additions and removals; a flag that the patch
        lacks (or has as None) stays."""
        gone = {str(p).lower() for p in patch.get("excluded_platforms_remove") or []}
        off = {str(s).lower() for s in patch.get("disabled_sources_remove") or []}
        platforms = [*self.excluded_platforms, *(str(p) for p in patch.get("excluded_platforms_add") or [] if p)]
        sources = [*self.disabled_sources, *(str(s).lower() for s in patch.get("disabled_sources_add") or [] if s)]
        flag = lambda name, now: now if patch.get(name) is None else bool(patch[name])
        rule = (patch.get("save_rule") or "").strip()
        return Preferences(
            [p for p in dict.fromkeys(platforms) if p.lower() not in gone],
            [s for s in dict.fromkeys(sources) if s not in off],
            flag("search_kit_component_links", self.component_links),
            flag("force_kit_component_pricing", self.component_pricing),
            list(dict.fromkeys([*self.rules, *([rule] if rule else [])])),
        )
