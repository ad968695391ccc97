"""assayframe.sources"""
