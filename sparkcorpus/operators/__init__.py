"""Jobs on DataFrames, one module for each part of the data flow."""
