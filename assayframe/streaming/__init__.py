"""assayframe.streaming"""
