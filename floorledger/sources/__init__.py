"""Reading workbooks and history tables, and the month-replacing history sink."""
