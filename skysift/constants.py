"""Fixed product properties and the tile-grid geometry."""

from __future__ import annotations

from dataclasses import dataclass
from math import lcm

# Instrument band order (the index is the XML ``band_id``) and
# the native ground resolution of each band in metres.
BANDS = (
    "B01", "B02", "B03", "B04", "B05", "B06", "B07",
    "B08", "B8A", "B09", "B10", "B11", "B12",
)
BANDS_BY_RESOLUTION = {
    10: ("B02", "B03", "B04", "B08"),
    20: ("B05", "B06", "B07", "B8A", "B11", "B12"),
    60: ("B01", "B09", "B10"),
}
RESOLUTIONS = tuple(BANDS_BY_RESOLUTION)
# The ten bands the boosted-tree cloud model looks at.
MODEL_BANDS = ("B01", "B02", "B04", "B05", "B08", "B8A", "B09", "B10", "B11", "B12")

# keep/discard limits of a tile.
MAX_CLOUD_PERCENT = 30
MAX_NODATA_FRACTION = 0.5

# Report columns, in file order.
REPORT_COLUMNS = (
    "min_latitude", "min_longitude", "max_latitude", "max_longitude",
    "cloud_cover_percent", "valid",
)
GEOJSON_DECIMALS = 6
PROB_SCALE = 1 << 24

# Default detector parameters.
THRESHOLD_DEFAULTS = {"t_bright": 0.18, "t_ndsi": -0.20, "t_cirrus": 0.005}
MODEL_DEFAULTS = {"prob_threshold": 0.4, "average_over": 1, "dilation_size": 1}
NAIVE_RULE = {"t_bright": 0.33, "t_ndsi": -1.0, "t_cirrus": 1.0}
QUANT_RANGES = {"brightness": (0.0, 1.0), "ndsi": (-1.0, 1.0), "b10": (0.0, 0.02)}

# Tiles inspected by name in every scene, with their character.
NAMED_TILES = (
    (11, 2, "genuinely clear"),
    (6, 5, "moderate cloud"),
    (5, 16, "heavy cloud"),
    (12, 19, "thin cirrus veil"),
)
AUDIT_TOP = 12


@dataclass(frozen=True)
class SceneGrid:
    """Tiling of one scene on the 10 m grid.

    A *block* is the smallest square that no tile and no 60 m pixel straddles;
    pixel tables at every resolution are co-partitioned by block.
    """

    tile_px: int = 549
    rows: int = 20
    cols: int = 20
    metres: int = 10

    @property
    def height(self) -> int:
        return self.tile_px * self.rows

    @property
    def width(self) -> int:
        return self.tile_px * self.cols

    @property
    def tile_pixels(self) -> int:
        return self.tile_px * self.tile_px

    @property
    def tile_metres(self) -> int:
        return self.tile_px * self.metres

    @property
    def block_px(self) -> int:
        return lcm(self.tile_px, 6)

    def shape(self, resolution: int) -> tuple[int, int]:
        f = resolution // self.metres
        return self.height // f, self.width // f


FULL_GRID = SceneGrid()
