"""assayframe.operators"""
