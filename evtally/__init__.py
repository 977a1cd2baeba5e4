"""An evidence-accounting engine on Spark DataFrames."""
