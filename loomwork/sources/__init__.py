"""Sources: tables with declared schemas, pages, files, and generated fixtures."""
