"""Parameters of a run and their defaults, errors of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.fusion import Blend, Select


@dataclass(frozen=True)
class Params:
    registration_level: int = 3
    focus_radius: int = 4
    guide_radius: int = 4
    guide_epsilon: float = 1e-4
    guide_perceptual: bool = True
    fusion: Select | Blend = Select(2)
    pyramid_floor: int = 32


class RasterError(Exception):
    """Base of the errors that a run can end with."""


class NoFrames(RasterError):
    """A folder holds no frame."""


class NoStacks(RasterError):
    """No folder below the root is a stack."""


class Geometry(RasterError):
    """Frames of a stack differ in size or sample layout."""


class UnsupportedFormat(RasterError):
    """A file is not a 16-bit RGB image of a readable layout."""


class Bounds(RasterError):
    """Rows outside the image were asked for."""


class BufferSize(RasterError):
    """A buffer does not fit the rows."""


class OutputInsideStack(RasterError):
    """The result would become a frame of its own stack."""


class Cancelled(RasterError):
    """The run was cancelled."""
