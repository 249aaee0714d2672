"""Writers for GeoJSON, the stop relation table and the output manifest."""
