"""runweave: DataFrame operators for collections of one-dimensional run grids."""
