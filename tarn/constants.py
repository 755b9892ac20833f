"""Fixed values of the domain."""

# Bands in order, their scale and the mark of missing pixels.
BANDS = ("b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b8a", "b11", "b12")
CLEAR = "clear_count"
REFLECTANCE_SCALE = 10000.0
NODATA = 65535

# Classes of pixels, texture, and the least divisor.
MNDWI_WATER = 0.0
NDWI_WATER, NDVI_WATER = -0.05, 0.1
NDVI_VEGETATION = 0.2
TEXTURE_BAND, TEXTURE_LEVELS = "b8", 64
TEXTURE_OFFSETS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))
EPSILON = 1e-10

# Trajectories and forecasts.
WINDOW = 5
SIMILARITY_FLOOR = 0.5
TOP_K, MAX_TOP_K = 10, 50
RANK_WEIGHTS = (0.28, 0.24, 0.20, 0.16, 0.12)
MIN_TWINS, HORIZON, NOISE_SHARE, MIN_SAMPLES = 2, 3, 0.5, 30
FALLBACK_THRESHOLDS = {
    "ndci": 0.005,
    "ndvi": 0.005,
    "ndwi": 0.005,
    "turbidity": 0.005,
    "red_edge_slope": 0.001,
}
FALLBACK_HORIZON = 5
FEATURE_VERSION = EMBEDDING_VERSION = 2

# Encoder input, tokens and blending.
INPUT_BANDS = ("b2", "b3", "b4", "b8a", "b11", "b12")
INPUT_MEAN = (
    775.2290211032589,
    1080.992780391705,
    1228.5855250417867,
    2497.2022620507532,
    2204.2139147975554,
    1610.8324823273745,
)
INPUT_STD = (
    1281.526139861424,
    1270.0297974547493,
    1399.4802505642526,
    1368.3446143747644,
    1291.6764008585435,
    1154.505683480695,
)
TOKEN_PX, WINDOW_PX = 16, 224
LAKE_WEIGHT, MIN_LAKE_PIXELS = 0.7, 100

# Geography.
EARTH_RADIUS_KM = 6371.0
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165
TILE_M, BUFFER_M, SCALE_M = 25000.0, 3500.0, 30.0
ACTIVE_KM2 = 2.0

# Wording of forecasts.
INDEX_LABELS = {
    "ndci": "NDCI (Chlorophyll-a)",
    "ndvi": "NDVI (Vegetation Vigor)",
    "ndwi": "NDWI (Water Mask)",
    "turbidity": "Turbidity",
    "red_edge_slope": "Red Edge Slope (Pigment Trend)",
}
ARROWS = {"up": "↑", "down": "↓", "stable": "→", "uncertain": "?"}

# What parameters may be.
TOP_KS, HORIZONS, ANALOGS = (1, 50), (1, 10), (1, 20)
LATITUDES, LONGITUDES, YEARS = (-90.0, 90.0), (-180.0, 180.0), (2015, 2025)

# Attributes that name a state, in order; words, colours and zone of reports.
STATE_NAMES = ("state_name", "state", "st_nm", "name_1", "name", "shapename")
METHOD_LABELS = {"cosine": "Cosine", "euclidean": "Euclidean", "knn": "KNN"}
MATCH_QUALITIES = ((0.90, "Excellent"), (0.80, "Strong"), (0.70, "Moderate"), (0.0, "Low"))
SIMILARITY_COLORS = ((0.85, "#22c55e"), (0.70, "#84cc16"), (0.55, "#eab308"), (0.40, "#f97316"), (0.0, "#ef4444"))
REPORT_ZONE = "Asia/Kolkata"
