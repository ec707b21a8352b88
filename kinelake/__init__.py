"""kinelake: episode analytics for robot data, expressed as Spark DataFrames."""
