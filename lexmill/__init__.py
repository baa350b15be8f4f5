"""lexmill: evidence-grounded retrieval over structured text, on DataFrames."""
