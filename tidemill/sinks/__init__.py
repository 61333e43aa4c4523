"""Writers: CSV, workbook, terminal."""
