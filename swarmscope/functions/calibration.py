"""Camera calibration: millimetres a pixel and the observed volume."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Calibration:
    """Field of view in mm, image shape in px, and the depth of focus in mm."""

    width_mm: float = 14.6
    height_mm: float = 11.7
    width_px: int = 1280
    height_px: int = 1024
    depth_mm: float = 40.0

    @property
    def mm_per_px(self) -> float:
        return (self.width_mm / self.width_px + self.height_mm / self.height_px) / 2

    def observed_volume_mm3(self, depth_mm: float | None = None) -> float:
        return self.width_mm * self.height_mm * (self.depth_mm if depth_mm is None else depth_mm)


DEFAULT = Calibration()
