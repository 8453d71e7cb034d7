"""From incoming files, API pages and database extracts to raw tables."""
