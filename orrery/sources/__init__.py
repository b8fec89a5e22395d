"""Where rows come from: versioned tables, files, multi-part folders, Delta snapshots, catalog views."""
