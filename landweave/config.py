"""Weights, thresholds and vocabularies of the reconciliation pipeline."""

from __future__ import annotations

from dataclasses import dataclass

#: Weight of a source type.
SOURCE_WEIGHT = {
    "GNSS_SURVEY": 1.00, "GROUND_TRUTH": 0.95, "DRONE_ORI": 0.90, "DSM_DTM": 0.85, "CADASTRAL": 0.80, "REVENUE_ROR": 0.75, "MUNICIPAL_GIS": 0.70,
    "BUILDING_FOOTPRINT": 0.65, "UTILITY_NETWORK": 0.65, "ADMINISTRATIVE": 0.60, "ROAD_NETWORK": 0.60, "HISTORICAL": 0.50, "UNKNOWN": 0.40,
}
#: Source types whose records are matched into parcels.
PARCEL_TYPES = ("CADASTRAL", "REVENUE_ROR", "MUNICIPAL_GIS", "DRONE_ORI", "GNSS_SURVEY", "HISTORICAL", "UNKNOWN")
#: Canonical fields and the normalised names they are known by, in order.
FIELD_ALIASES = {
    "parcel_reference": "khasra_no khasra khasra_number property_id propertyid parcel_id parcelid plot_no plot_number survey_no khata_no khata_number holding_no gat_no dag_no",
    "ulpin": "ulpin bhu_aadhaar bhu_aadhar uid",
    "owner_reference": "owner_name owner khatadar bhumiswami occupant applicant_name holder_name",
    "area": "area plot_area measured_area parcel_area extent area_sqm area_sqft area_ha area_acre bhumi_area",
    "area_unit": "unit area_unit",
    "land_use": "land_use use usage_type land_type land_class land_category classification land_classification zone use_type",
    "address": "address postal_address full_address",
    "ward": "ward ward_no ward_number ward_name zone_no",
    "village": "village village_name locality mohalla gram",
    "survey_number": "survey_number mutation_no mutation_number",
    "mutation_date": "mutation_date date_of_mutation last_updated",
    "capture_date": "capture_date survey_date date_of_survey acquisition_date date timestamp",
    "dsm_mean_m": "dsm_mean_m dsm_mean", "dsm_min_m": "dsm_min_m", "dsm_max_m": "dsm_max_m",
    "dtm_mean_m": "dtm_mean_m dtm_mean", "dtm_min_m": "dtm_min_m", "dtm_max_m": "dtm_max_m",
    "estimated_building_height_m": "building_height_m estimated_building_height_m",
    "has_structure": "has_structure", "resolution_m": "resolution_m", "elevation_source_type": "elevation_source_type",
    "gnss_method": "gnss_method", "horizontal_accuracy_m": "horizontal_accuracy_m", "vertical_accuracy_m": "vertical_accuracy_m", "pdop": "pdop",
    "cors_station": "cors_station", "baseline_length_km": "baseline_length_km", "mark_type": "mark_type",
    "gt_category": "gt_category", "gt_confidence": "gt_confidence", "observed_value": "observed_value",
    "contradicts_source": "contradicts_source", "supports_source": "supports_source",
}
ALIASES = {alias: field for field, names in FIELD_ALIASES.items() for alias in names.split()}
#: Square metres of an area unit.
AREA_UNITS = {
    "sqm": 1.0, "m2": 1.0, "m²": 1.0, "sqft": 0.0929, "sqfeet": 0.0929, "ft2": 0.0929, "acre": 4046.86, "acres": 4046.86, "hectare": 10000.0,
    "ha": 10000.0, "sqyd": 0.8361, "sqyard": 0.8361, "guntha": 101.17, "gunta": 101.17, "cent": 40.47,
}
#: GNSS methods in order of lookup with their quality and nominal accuracy in metres.
GNSS_QUALITY = {"rtk_cors": 1.00, "rtk_local": 0.95, "post_processed_static": 0.90, "dgnss": 0.80, "sbas": 0.78, "autonomous": 0.55, "single_frequency": 0.60, "unknown": 0.70}
GNSS_ACCURACY_M = {"rtk_cors": 0.02, "rtk_local": 0.05, "post_processed_static": 0.10, "dgnss": 0.50, "sbas": 0.80, "autonomous": 3.00, "single_frequency": 1.50, "unknown": 1.00}
#: Ground-truth categories, in the order of lookup.
GT_CATEGORIES = ("boundary_mark", "building_present", "no_building", "land_use", "encroachment", "access_road", "utility_present", "water_body", "open_land", "other")
#: Attribute names that may hold a parcel's national number, in order.
ULPIN_KEYS = ("ulpin", "ULPIN", "Ulpin", "bhu_aadhaar", "bhu_aadhar", "Bhu_Aadhaar", "bhuu_aadhaar", "uid", "UID", "unique_id", "parcel_uid", "land_uid")
#: Declared reference systems that mean longitude and latitude.
WGS84_NAMES = ("EPSG:4326", "WGS84", "CRS:84", "urn:ogc:def:crs:EPSG::4326")
#: Titles dropped from names, and phrases that end a name.
HONORIFICS = ("shri", "smt", "sri", "sh", "late", "mr", "mrs", "dr", "prof", "km", "ku", "kumari", "col", "adv", "er", "श्री", "श्रीमती", "सौ", "स्व")
RELATIONAL = r"(?i)\b(?:s/?o|d/?o|w/?o|son of|daughter of|wife of|wd of|putra|putri|patni|widow of|s\.o|d\.o|w\.o)\b"
#: Phonetic digit of a consonant or digraph.
PHONETIC = {
    "b": "1", "bh": "1", "p": "1", "ph": "1", "v": "1", "w": "1", "c": "2", "ch": "2", "g": "2", "gh": "2", "j": "2", "jh": "2", "k": "2", "kh": "2", "q": "2",
    "d": "3", "dh": "3", "t": "3", "th": "3", "l": "4", "r": "4", "m": "5", "n": "5", "f": "6", "s": "6", "sh": "6", "x": "6", "z": "6", "h": "0", "y": "0",
}
#: Review points of an unresolved conflict.
SEVERITY_POINTS = {"CRITICAL": 100, "HIGH": 70, "MEDIUM": 40, "LOW": 10}
#: Least Hausdorff distance in metres and least relative area difference of a severity.
SEVERITY_FROM = (("CRITICAL", 5.0, 0.10), ("HIGH", 2.0, 0.05), ("MEDIUM", 0.5, 0.02))
#: Scales of the ripple checks and of the topology corrections, rougher than those of the measures.
RIPPLE_SQM_PER_DEG2 = 12_391_000_000.0
RIPPLE_M_PER_DEG = 111_000.0
#: Limits of the ripple checks, in square metres and metres.
RIPPLE_LEAST = {"neighbor_sqm": 0.5, "neighbor_critical_sqm": 10.0, "building_sqm": 1.0, "line_m": 0.5, "road_sqm": 1.0}


@dataclass(frozen=True)
class Config:
    """Thresholds of matching, conflicts, proposals and review; the defaults are fixed values."""

    buffer_deg: float = 0.01
    weight_geometry: float = 0.35
    weight_identifier: float = 0.25
    weight_attribute: float = 0.15
    weight_temporal: float = 0.10
    weight_provenance: float = 0.15
    match_at: float = 0.60
    review_below: float = 0.75
    high_at: float = 0.88
    conflict_iou: float = 0.95
    conflict_hausdorff_m: float = 50.0
    conflict_area: float = 0.05
    owner_at: float = 0.70
    stated_area: float = 0.03
    temporal_gap_days: int = 365
    change_gap_days: int = 180
    auto_offset_m: float = 2.0
    auto_area_share: float = 0.05
    auto_confidence: float = 0.82
    auto_lineages: int = 2
    noise_m: float = 2.0
    most_adjustment: float = 0.7
    fuzzy_field_at: float = 75.0


DEFAULT = Config()
