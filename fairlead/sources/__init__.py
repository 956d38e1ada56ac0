"""Reading and writing: raw CSV reports, position tables, staged tables, result documents."""
