"""Result files: JSON lines, GeoJSON, analysis documents, CSV."""
