"""Text segmentation and text analytics on Spark DataFrames."""
