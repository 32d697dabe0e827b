"""Signal metrics, decision tables, joins and reports over DataFrames."""
