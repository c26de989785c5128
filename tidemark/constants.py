"""Results depend on them, so they are stated once and plainly."""

#: Decibels from which on a sample is no data.
NODATA_DB = 17.0
#: Thresholds of the z-score detector as it is made, and as the mapping stage sets them.
DETECTOR_THRESHOLD = -2.5
STAGE_THRESHOLD = -3.0
#: Degrees of slope from which on a pixel cannot flood.
SLOPE_LIMIT = 15.0
CELL_SIZE = 30.0
#: In monthly counts: no valid date in the month.
MONTH_NODATA = 255
#: Float32's largest value, which marks gaps in stored baselines.
FLOAT32_MAX = 3.4028234663852886e38
#: Metres and degrees added around an area before imagery and terrain are read.
SCENE_MARGIN_M = 5000.0
DEM_MARGIN_DEG = 0.02
SLOPE_BUFFER_M = 500.0
#: Otsu detector: least valid pixels, bins, bins and window of the peak test, least height of a peak (1 / 20).
OTSU_LEAST_VALID = 100
OTSU_BINS = 256
PEAK_BINS = 32
PEAK_WINDOW = 5
PEAK_ONE_IN = 20
#: Latitude bands from 80 S in steps of 8 degrees.
LATITUDE_BANDS = "CDEFGHJKLMNPQRSTUVWX"
#: Letters of 100 km squares, columns by zone number modulo 3, rows by its parity.
SQUARE_COLUMNS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")
SQUARE_ROWS = ("FGHJKLMNPQRSTUVABCDE", "ABCDEFGHJKLMNPQRSTUV")
#: Dry months of a tile whose season nobody has set yet.
DRY_MONTH_PLACEHOLDER = "REQUIRED"
#: Flood classes.
NOT_FLOODED, VH_ONLY, VV_ONLY, BOTH = 0, 1, 2, 3
