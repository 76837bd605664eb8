"""Behaviour analytics over labelled multichannel sensor recordings, on Spark DataFrames."""
