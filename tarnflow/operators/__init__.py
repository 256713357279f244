"""Page extraction, statistics, drift signals, acceptance gates and candidate ranking over DataFrames."""
