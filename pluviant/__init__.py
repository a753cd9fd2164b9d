"""pluviant: tracked weather systems and gridded precipitation on Spark DataFrames."""
