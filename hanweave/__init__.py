"""Chinese and mixed-script text analytics on Spark DataFrames."""
