"""DataFrame operators. Each takes and returns DataFrames and stays lazy unless it says otherwise."""
